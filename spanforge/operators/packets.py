"""From packets to relations: resolved events, descriptors, annotations; and the summary of a trace's calls."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from . import callgraph, interning, tracks


def sequences(packets: DataFrame) -> DataFrame:
    """seq (trace and sequence id; a missing id is 0), packet_idx, dropped, cleared, needs."""
    flags = F.coalesce("sequence_flags", F.lit(0))
    return packets.select(
        seq_key().alias("seq"), "packet_idx", F.coalesce("dropped", F.lit(False)).alias("dropped"),
        (flags.bitwiseAND(F.lit(interning.CLEARED)) != 0).alias("cleared"), (flags.bitwiseAND(F.lit(interning.NEEDS)) != 0).alias("needs"),
    )


def seq_key() -> Column:
    return F.concat("trace", F.lit("#"), F.coalesce("seq_id", F.lit(0)).cast("string"))


def dictionary(packets: DataFrame) -> DataFrame:
    e = packets.select(seq_key().alias("seq"), "packet_idx", F.explode("entries").alias("e"))
    return e.select("seq", "packet_idx", "e.pos", "e.table", "e.iid", V.utf8(F.col("e.value")).alias("value"))


def descriptors(packets: DataFrame) -> DataFrame:
    d = packets.where("descriptor is not null")
    name = V.descriptor_name(F.col("descriptor.thread_name"), F.col("descriptor.name"), F.col("descriptor.process_name"), F.col("descriptor.uuid"))
    return d.select("trace", F.col("descriptor.uuid").alias("track"), "packet_idx", name.alias("name"), F.col("descriptor.parent_uuid").alias("parent"), F.col("descriptor.name").alias("own_name"))


def events(packets: DataFrame, *, strict: bool = False) -> DataFrame:
    """trace, packet_idx, track, ts, type, name (resolved)."""
    e = packets.where("event is not null").select("trace", seq_key().alias("seq"), "packet_idx", F.lit("event_names").alias("table"), F.col("event.name_iid").alias("iid"), F.col("event.name").alias("inline"), F.col("event.track_uuid").alias("track"), F.col("event.type").alias("type"), V.time_or_index(F.col("timestamp"), F.col("packet_idx")).alias("ts"))
    r = interning.resolved(e, dictionary(packets), sequences(packets), strict=strict)
    return r.select("trace", "packet_idx", "track", "ts", "type", F.col("text").alias("name"))


def annotations(packets: DataFrame) -> DataFrame:
    """A row per annotation at every depth: trace, packet_idx, path, holder, k (name), kind, and its values; text resolved."""
    a = packets.where("event is not null").select("trace", seq_key().alias("seq"), "packet_idx", F.explode("event.annotations").alias("a")).select("trace", "seq", "packet_idx", "a.*")
    names = interning.resolved(a.withColumns({"table": F.lit("debug_annotation_names"), "iid": F.col("name_iid"), "inline": F.col("name")}), dictionary(packets), sequences(packets))
    names = names.withColumn("k", F.col("text")).drop("text", "table", "iid", "inline")
    texts = interning.resolved(names.withColumns({"table": F.lit("debug_annotation_string_values"), "iid": F.col("str_iid"), "inline": F.col("str_v")}), dictionary(packets), sequences(packets))
    return texts.select("trace", "packet_idx", "path", "holder", "k", "kind", "bool_v", F.coalesce(F.col("int_v").cast("decimal(20,0)"), "uint_v").alias("int_v"), "dbl_v", F.col("text").alias("str_v"))


def _leaf_json() -> Column:
    """A value inside a dictionary or array as compact JSON; numbers stay numbers there."""
    text = F.to_json(F.struct(F.col("str_v").alias("v")))
    quoted = F.when(F.col("str_v").isNull(), "null").otherwise(text.substr(F.lit(6), F.length(text) - 6))
    return F.when(F.col("kind").isin("int", "uint", "pointer"), F.col("int_v").cast("string")).when(F.col("kind") == "double", V.double_text(F.col("dbl_v"))).when(F.col("kind") == "bool", F.col("bool_v").cast("string")).when(F.col("kind").isin("string", "legacy_json"), quoted).otherwise("null")


def nested_json(anns: DataFrame) -> DataFrame:
    """Top-level annotations with `json`: containers as compact JSON, keys sorted, of equal keys the last. Folded from the deepest level up."""
    deepest = anns.agg(F.max(F.size("path"))).first()[0] or 1
    rows = anns.withColumn("json", F.when(~F.col("kind").isin("dict", "array"), _leaf_json()))
    for level in range(deepest, 1, -1):
        here, above = rows.where(F.size("path") == level), rows.where(F.size("path") < level)
        key = F.to_json(F.struct(F.col("k").alias("v")))
        members = here.select("trace", "packet_idx", F.slice("path", 1, level - 1).alias("up"), "holder", F.element_at("path", -1).alias("i"), "k", F.when(F.col("k").isNull(), '""').otherwise(key.substr(F.lit(6), F.length(key) - 6)).alias("q"), "json")
        last = Window.partitionBy("trace", "packet_idx", "up", "k").orderBy(F.desc("i"))
        members = members.withColumn("r", F.when(F.col("holder") == "dict", F.row_number().over(last)).otherwise(1)).where("r = 1")
        in_order = F.when(F.col("holder") == "dict", F.struct(F.coalesce("k", F.lit("")).alias("o"), F.lit(0).alias("i"), F.concat("q", F.lit(":"), "json").alias("t"))).otherwise(F.struct(F.lit("").alias("o"), F.col("i"), F.col("json").alias("t")))
        made = members.groupBy("trace", "packet_idx", "up").agg(F.first("holder").alias("h"), F.array_sort(F.collect_list(in_order)).alias("m"))
        body = F.array_join(F.transform("m", lambda x: x["t"]), ",")
        made = made.select("trace", "packet_idx", F.col("up").alias("path"), F.when(F.col("h") == "dict", F.concat(F.lit("{"), body, F.lit("}"))).otherwise(F.concat(F.lit("["), body, F.lit("]"))).alias("__made"))
        rows = above.join(made, ["trace", "packet_idx", "path"], "left").withColumn("json", F.coalesce("json", "__made")).drop("__made")
    return rows.where(F.size("path") == 1)


def payload_entries(packets: DataFrame, int_format: str = "hex") -> DataFrame:
    """trace, packet_idx, pos, k, v: normalised annotations of events."""
    a = nested_json(annotations(packets))
    text = F.when(F.col("kind") == "legacy_json", F.lit("string")).otherwise(F.col("kind"))
    v = callgraph.normalised_value(text, F.col("int_v"), F.col("dbl_v"), F.col("bool_v"), F.col("str_v"), F.col("json"), int_format)
    return a.select("trace", "packet_idx", F.element_at("path", 1).alias("pos"), "k", v.alias("v"))


def call_summary(packets: DataFrame, *, include: Sequence[str] = (), exclude: Sequence[str] = (), ignore: Iterable[str] = (), name_map: DataFrame | None = None, name_format: str = "name@addr", int_format: str = "hex") -> tuple[DataFrame, DataFrame]:
    """Nodes and arguments of the calls of one trace."""
    e = tracks.named_as_of(events(packets).where(F.col("type").isin(1, 2)), descriptors(packets).select("track", "packet_idx", "name"))
    return callgraph.summary(e, payload_entries(packets, int_format).drop("trace"), ignore=ignore, include=include, exclude=exclude, name_map=name_map, name_format=name_format)


def call_summary_yaml(packets: DataFrame, **options) -> str:
    nodes, args = call_summary(packets, **options)
    return callgraph.yaml_text(nodes.toLocalIterator(), args.toLocalIterator())


def compared_entries(packets: DataFrame) -> DataFrame:
    """trace, packet_idx, entries: top-level annotations as (k, v) texts of the comparison, last of equal names, sorted."""
    a = annotations(packets).where(F.size("path") == 1)
    v = V.compared_text(F.col("kind"), F.col("str_v"), F.col("int_v"), F.col("dbl_v"), F.col("bool_v"))
    a = callgraph.last_wins(a.select("trace", "packet_idx", F.element_at("path", 1).alias("pos"), F.coalesce("k", F.lit("")).alias("k"), v.alias("v")), ("trace", "packet_idx"))
    return a.groupBy("trace", "packet_idx").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("entries"))


def instants(packets: DataFrame, track: DataFrame, prefix: str = "") -> DataFrame:
    """ts, packet_idx, name, text, and a map of annotations, of a track's instant events; track: one row, or none."""
    e = events(packets).where((F.col("type") == 3) & F.coalesce("name", F.lit("")).startswith(prefix))
    e = e.join(F.broadcast(track), "track", "left_semi").join(compared_entries(packets), ["trace", "packet_idx"], "left")
    own = F.coalesce("entries", F.array().cast("array<struct<k:string,v:string>>"))
    return e.select("ts", "packet_idx", "name", V.annotation_text(own).alias("text"), F.map_from_entries(own).alias("a"))
