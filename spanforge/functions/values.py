"""Scalar rules of the trace model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name endings and, in two dialects, whole names that mark an integer as a pointer.
POINTER_ENDINGS = ("_addr", "_address", "_pc", "_sp", "_pointer")
POINTER_NAMES = ("pc", "sp", "address")
DIALECTS = ("py", "cpp", "rust")


def is_pointer_name(name: Column, dialect: str = "py") -> Column:
    """py: endings in any case; cpp: endings and whole names in lower case only; rust: both in any case."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect: {dialect!r}")
    n = name if dialect == "cpp" else F.lower(name)
    ends = n.rlike(f"({'|'.join(POINTER_ENDINGS)})$")
    return ends if dialect == "py" else ends | n.isin(*POINTER_NAMES)


def hex_upper(v: Column, digits: int = 0) -> Column:
    """0x and capital hex digits, at least `digits`; negatives as -0x... of the magnitude, printed 0x-5."""
    return F.concat(F.lit("0x"), F.when(v < 0, "-").otherwise(""), _digits(F.abs(v), digits))


def hex_wide(v: Column) -> Column:
    """As hex_upper, for whole numbers from -2^63 to 2^64 - 1 in any integer or decimal type."""
    d, whole = v.cast("decimal(21,0)"), lambda n: F.lit(str(n)).cast("decimal(21,0)")
    low = F.when(d >= whole(2**63), d - whole(2**64)).when(d > whole(-(2**63)), F.abs(d)).otherwise(d)
    return F.concat(F.lit("0x"), F.when(d < 0, "-").otherwise(""), F.hex(low.cast("bigint")))


def _digits(v: Column, digits: int) -> Column:
    h = F.hex(v)
    return F.when(F.length(h) < digits, F.lpad(h, digits, "0")).otherwise(h) if digits else h


def parse_int(text: Column) -> Column:
    """0x hex or decimal; anything else is null."""
    low = F.lower(F.trim(text))
    is_hex = low.rlike(r"^0x[0-9a-f]+$")
    return F.when(is_hex, F.conv(F.substring(low, 3, 64), 16, 10).try_cast("bigint")).when(low.rlike(r"^[+-]?[0-9]+$"), low.try_cast("bigint"))


def first_address(name: Column) -> Column:
    """The value of the first 0x... in a name; null if there is none."""
    h = F.regexp_extract(name, r"0x([0-9A-Fa-f]+)", 1)
    return F.when(h != "", F.conv(h, 16, 10).try_cast("bigint"))


def descriptor_name(thread_name: Column, name: Column, process_name: Column, uuid: Column) -> Column:
    """Thread name, name, process name, then track_<uuid>; an empty string counts as missing."""
    some = [F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in (thread_name, name, process_name)]
    return F.coalesce(*some, F.concat(F.lit("track_"), uuid.cast("string")))


def time_or_index(ts: Column, packet_idx: Column) -> Column:
    """A missing or zero timestamp falls back to the packet's place in the file."""
    return F.coalesce(F.nullif(ts, F.lit(0).cast("bigint")), packet_idx)


def floor_us(ns: Column) -> Column:
    """Nanoseconds to microseconds, rounded down below zero too, without going through a double."""
    return F.floor((ns - F.pmod(ns, F.lit(1000))).cast("decimal(20,0)") / 1000).cast("bigint")


def utf8(b: Column) -> Column:
    """Bytes as text; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(b.cast("string"))


def value_kind(kind: Column, name: Column, dialect: str = "py") -> Column:
    """The field that a value of a host-language kind (bool, int, uint, float, str, other) is written to.

    Integers with a pointer's name become pointers. Unsigned ones are integers (py), always pointers (cpp), or unsigned (rust).
    """
    ptr = is_pointer_name(name, dialect)
    uint = {"py": F.when(ptr, "pointer").otherwise("int"), "cpp": F.lit("pointer"), "rust": F.when(ptr, "pointer").otherwise("uint")}[dialect]
    return F.when(kind == "bool", "bool").when(kind == "int", F.when(ptr, "pointer").otherwise("int")).when(kind == "uint", uint).when(kind == "float", "double").otherwise("string")


def double_text(v: Column) -> Column:
    """A double as the shortest decimal text that reads back, in the layout 1e+16 / 1.5 / nan."""
    s = v.cast("string")
    m, e = F.substring_index(s, "E", 1), F.substring_index(s, "E", -1).try_cast("int")
    mantissa = F.regexp_replace(m, r"\.0$", "")
    sci = F.concat(mantissa, F.when(e < 0, "e-").otherwise("e+"), F.when(F.abs(e) < 10, F.lpad(F.abs(e).cast("string"), 2, "0")).otherwise(F.abs(e).cast("string")))
    a = F.abs(v)
    plain = F.when((a >= 1e7) & (a < 1e16) | (a >= 1e-4) & (a < 1e-3), _plain(v))
    return F.when(F.isnan(v), "nan").when(a == float("inf"), F.when(v > 0, "inf").otherwise("-inf")).when(s.contains("E"), F.coalesce(plain, sci)).otherwise(s)


def _plain(v: Column) -> Column:
    """Spark's digits, moved out of the E notation."""
    d = v.cast("string").cast("decimal(38,18)").cast("string")
    d = F.regexp_replace(d, r"0+$", "")
    return F.regexp_replace(d, r"\.$", ".0")


def compared_text(kind: Column, s: Column, i: Column, d: Column, b: Column) -> Column:
    """A value as the comparison prints it; dictionaries, arrays and empty values are <unknown>."""
    return (
        F.when(kind == "string", s)
        .when(kind.isin("int", "uint"), i.cast("string"))
        .when(kind == "bool", F.when(b, "true").otherwise("false"))
        .when(kind == "double", double_text(d))
        .when(kind == "pointer", hex_wide(i))
        .otherwise("<unknown>")
    )


def stripped_hex(text: Column) -> Column:
    """0x00ff -> FF, 0x0 -> 0; other text stays."""
    d = F.regexp_replace(F.upper(F.substring(text, 3, 1000)), r"^0+", "")
    return F.when(text.startswith("0x"), F.when(d == "", "0").otherwise(d)).otherwise(text)


#: Characters that make a YAML key or value quoted.
YAML_SPECIAL = r"""[:#{}\[\]&*?|\-<>=!%@\\"]"""


def yaml_key(text: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when((text == "") | text.rlike(YAML_SPECIAL) | text.rlike(r"^\p{Nd}"), quoted).otherwise(text)


def yaml_value(text: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when((text == "") | text.rlike(YAML_SPECIAL) | F.lower(text).isin("null", "true", "false"), quoted).otherwise(text)


def annotation_text(entries: Column) -> Column:
    """Sorted k=v joined by "; ", from an array of (k, v)."""
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["k"], F.lit("="), e["v"])), "; ")
