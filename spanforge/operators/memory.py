"""Memory writes as single bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import parse_int


def single_bytes(writes: DataFrame) -> DataFrame:
    """writes: packet_idx, offset, address, addr, value, pc, size (texts, null where absent) and any more.

    A write of several bytes becomes one row per byte, little-endian, with formatted address and value; a single byte keeps its texts, only
    the key is unified. Adds byte_no, key (offset or addr), addr_text, value_text.

    Of a write of several bytes, size, address and value must be numbers, else the query fails: hexadecimal of any length, decimal below 2^64, decimal values above -2^63 too.
    """
    inner = F.col("offset").isNotNull()
    w = writes.withColumns({"__n": F.when(F.col("size").isNull(), 1).otherwise(sure(F.col("size"), parse_int(F.col("size"))))})
    many = F.col("__n") > 1
    w = w.withColumn("__base", F.when(many, sure_hex(F.coalesce("offset", "address", "addr", F.lit("0x0")))))
    w = w.withColumn("__v", F.when(many, sure_hex(F.coalesce("value", F.lit("0x0")))))
    w = w.withColumn("__low", F.conv(F.right(F.col("__base"), F.lit(15)), 16, 10).cast("bigint"))
    w = w.withColumn("byte_no", F.explode(F.sequence(F.lit(0), F.greatest(F.col("__n"), F.lit(1)).cast("int") - 1)))
    # The low 15 digits as a number, and what it carries over to the digits above.
    low = F.col("__low") + F.col("byte_no")
    above = F.expr("left(__base, greatest(length(__base) - 15, 0))")
    above = F.when(low >= 16**15, F.hex(F.conv(F.concat(F.lit("0"), above), 16, 10).cast("bigint") + 1)).otherwise(above)
    long = F.regexp_replace(F.concat(above, F.lpad(F.hex(F.pmod(low, F.lit(16**15))), 15, "0")), "^0+(?=.)", "")
    at = F.when(F.length("__base") >= 15, long).otherwise(F.hex(low))
    padded = lambda c, digits: F.when(F.length(c) < digits, F.lpad(c, digits, "0")).otherwise(c)
    sign = F.when(F.col("value").startswith("-"), "F").otherwise("0")
    byte = F.expr("right(__v, 2 * byte_no + 2)")
    byte = F.when(F.length("__v") >= 2 * F.col("byte_no") + 2, F.left(byte, F.lit(2))).when(F.length("__v") == 2 * F.col("byte_no") + 1, F.concat(sign, F.left(F.col("__v"), F.lit(1)))).otherwise(F.concat(sign, sign))
    return w.withColumns(
        {
            "key": F.when(inner, "offset").otherwise("addr"),
            "addr_text": F.when(many, F.concat(F.lit("0x"), F.when(inner, padded(at, 2)).otherwise(padded(at, 6)))).otherwise(F.coalesce("offset", "address", "addr")),
            "value_text": F.when(many, F.concat(F.lit("0x"), byte)).otherwise(F.col("value")),
        }
    ).drop("__n", "__base", "__v", "__low")


def sure(text: Column, number: Column) -> Column:
    return F.coalesce(number, F.raise_error(F.concat(F.lit("no number: "), text)).cast("bigint"))


def sure_hex(text: Column) -> Column:
    """Capital hex digits of a number as text; of a negative one those of its 64 bits."""
    low = F.lower(F.trim(text))
    digits = F.when(low.rlike("^0x[0-9a-f]+$"), F.upper(F.substring(low, 3, 1 << 20)))
    whole = F.when(low.rlike("^[+]?[0-9]{1,19}$") | low.rlike("^[+]?1[0-9]{19}$"), F.conv(F.replace(low, F.lit("+")), 10, 16)).when(low.rlike("^-[0-9]{1,19}$"), F.hex(low.try_cast("bigint")))
    return F.coalesce(digits, whole, F.raise_error(F.concat(F.lit("no number: "), text)).cast("string"))
