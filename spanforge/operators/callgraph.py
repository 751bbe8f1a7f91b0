"""Call graphs: counts and argument histograms by path, and their YAML text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import first_address, hex_upper, hex_wide
from . import slices, tracks


def mapped_name(name: Column, track: Column, mapped: Column, name_format: str) -> Column:
    """A name whose first address is in the map, on the track Functions: name@0x001000, or the name alone."""
    full = mapped if name_format == "name" else F.concat(mapped, F.lit("@"), hex_upper(first_address(name), 6))
    return F.when((track == "Functions") & (F.coalesce(mapped, F.lit("")) != ""), full).otherwise(name)


def with_mapped_names(events: DataFrame, name_map: DataFrame | None, *, name_format: str = "name@addr") -> DataFrame:
    """Adds full_name, <track>::<name>. name_map: addr, mapped, and pos, of which the last wins; joined by address, so its size is Catalyst's to judge."""
    e = events.withColumn("name", F.coalesce("name", F.lit("")))
    if name_map is None:
        return e.withColumn("full_name", F.concat("track_name", F.lit("::"), "name"))
    m = name_map.groupBy(F.col("addr").alias("__a")).agg(F.max_by("mapped", "pos" if "pos" in name_map.columns else "mapped").alias("mapped"))
    e = e.join(m, first_address(F.col("name")) == F.col("__a"), "left")
    return e.withColumn("full_name", F.concat("track_name", F.lit("::"), mapped_name(F.col("name"), F.col("track_name"), F.col("mapped"), name_format))).drop("__a", "mapped")


def last_wins(entries: DataFrame, keys: Sequence[str] = ("packet_idx",)) -> DataFrame:
    """Annotations (keys, pos, k, v...) without unnamed ones; of several with one name the last."""
    w = Window.partitionBy(*keys, "k").orderBy(F.desc("pos"))
    return entries.where(F.coalesce("k", F.lit("")) != "").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def normalised_value(kind: Column, i: Column, d: Column, b: Column, s: Column, json: Column, int_format: str = "hex") -> Column:
    """A value as JSON text, so that equal text is an equal value: ints in hex or decimal, doubles with six places, nested ones compact."""
    quoted = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    whole = quoted(hex_wide(i)) if int_format == "hex" else i.cast("string")
    return (
        F.when(kind.isin("int", "uint", "pointer"), whole)
        .when(kind == "double", F.round(d, 6).cast("string"))
        .when(kind == "bool", F.when(b, "true").otherwise("false"))
        .when(kind == "string", quoted(s))
        .when(kind.isin("dict", "array"), quoted(json))
        .otherwise("null")
    )


def payloads(entries: DataFrame, ignore: Iterable[str] = ("depth",)) -> DataFrame:
    """packet_idx, payload: sorted (k, v) of the annotations that are not ignored, as an array; packets without any are left out."""
    e = last_wins(entries).where(~F.col("k").isin(*ignore)) if ignore else last_wins(entries)
    return e.groupBy("packet_idx").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("payload"))


def graph(events: DataFrame, *, track: str = "track_name", deepest: int | None = None) -> DataFrame:
    """Begin events with their path of full names. events: track_name, ts, type, packet_idx, full_name."""
    deep = slices.depths(events, track=track)
    return slices.with_path(deep.where(F.col("type") == slices.BEGIN), F.col("full_name"), track=track, deepest=deepest)


def counted(begins: DataFrame) -> DataFrame:
    """path, count."""
    return begins.groupBy("path").agg(F.count(F.lit(1)).alias("count"))


def counted_args(begins: DataFrame, args: DataFrame) -> DataFrame:
    """path, payload, count; a begin without arguments counts nowhere."""
    return begins.select("packet_idx", "path").join(args, "packet_idx").groupBy("path", "payload").agg(F.count(F.lit(1)).alias("count"))


def summary(events: DataFrame, entries: DataFrame, *, ignore: Iterable[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = (), name_map: DataFrame | None = None, name_format: str = "name@addr") -> tuple[DataFrame, DataFrame]:
    """Nodes (path, count) and arguments (path, payload, count) of a trace. "depth" is always ignored."""
    e = with_mapped_names(tracks.chosen(events, include, exclude), name_map, name_format=name_format)
    begins = graph(e)
    return counted(begins), counted_args(begins, payloads(entries, {*ignore, "depth"}))


SPECIAL = set(":#{}[]&*?|-<>=!%@\\\"")


def _quoted(text: str, more: bool) -> str:
    return "'" + text.replace("'", "''") + "'" if not text or more or SPECIAL & set(text) else text


def yaml_text(nodes: Iterable, args: Iterable) -> str:
    """The report, from collected rows of summary(): one line per node and argument, by count, then name. Values are JSON text."""
    import json

    children: dict[tuple, list] = {}
    for n in nodes:
        children.setdefault(tuple(n["path"][:-1]), []).append((-n["count"], n["path"][-1]))
    by_path: dict[tuple, list] = {}
    for a in args:
        values = [(p["k"], json.loads(p["v"])) for p in a["payload"]]
        by_path.setdefault(tuple(a["path"]), []).append((-a["count"], [(k, str(v)) for k, v in values], values))
    lines = ["functions:"]
    stack = [((), iter(sorted(children.get((), []))), "  ")]
    while stack:
        path, rest, indent = stack[-1]
        node = next(rest, None)
        if node is None:
            stack.pop()
            continue
        own, pad = (*path, node[1]), indent + "  "
        lines += [f"{indent}{_quoted(node[1], node[1][:1].isdigit())}:", f"{pad}count: {-node[0]}"]
        if own in by_path:
            lines.append(f"{pad}args:")
            for count, _, values in sorted(by_path[own], key=lambda x: x[:2]):
                lines.append(f"{pad}  - count: {-count}")
                for k, v in values:
                    shown = "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else _quoted(v, v.lower() in ("null", "true", "false"))
                    lines.append(f"{pad}    {_quoted(k, k[:1].isdigit())}: {shown}")
        if own in children:
            lines.append(f"{pad}children:")
            stack.append((own, iter(sorted(children[own])), pad + "  "))
    return "\n".join(lines) + "\n"
