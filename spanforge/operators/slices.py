"""Slices: nesting depth, begin/end matching, parents and paths of begin and end events.

An END on an empty stack is ignored. With S the running sum of +1 and -1 on a track, the depth after an event is S - min(0, least S so
far). A track may hold most of the events, so running sum and minimum come in two steps: totals of (track, chunk of packets), a small
table that is summed over chunks, and then windows inside a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END, INSTANT, COUNTER = 1, 2, 3, 4


def ordered(events: DataFrame) -> DataFrame:
    """Begin and end events with their place in slice order, as columns to sort by: ts, track, type, packet_idx."""
    return events.where(F.col("type").isin(BEGIN, END))


def depths(events: DataFrame, *, track: str = "track", chunk_ns: int | None = None, chunk_rows: int = 100_000) -> DataFrame:
    """Adds depth (after the event), level (of the slice it begins or ends) and effective (false for an ignored END).

    events: track, ts, type, packet_idx. Chunks are spans of time, so that order within a track is order of chunks, then inside a chunk; unless given,
    a span is so long that about chunk_rows events fall into it, however short the trace.
    """
    if chunk_ns is None:
        lo, hi, n = ordered(events).agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
        chunk_ns = max(1, ((hi or 0) - (lo or 0) + 1) * chunk_rows // max(1, n))
    e = ordered(events).withColumn("chunk", F.floor(F.col("ts") / chunk_ns)).withColumn("step", F.when(F.col("type") == BEGIN, 1).otherwise(-1).cast("bigint"))
    order = [F.col("ts"), F.col("type"), F.col("packet_idx")]
    inside = Window.partitionBy(track, "chunk").orderBy(*order)
    e = e.withColumn("s", F.sum("step").over(inside)).withColumn("low", F.min("s").over(inside))
    totals = e.groupBy(track, "chunk").agg(F.sum("step").alias("t"), F.min("s").alias("m"))
    before = Window.partitionBy(track).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("s0", F.coalesce(F.sum("t").over(before), F.lit(0)))
    totals = totals.withColumn("m0", F.coalesce(F.min(F.col("s0") + F.col("m")).over(before), F.lit(0)))
    e = e.join(totals.select(track, "chunk", "s0", "m0"), [track, "chunk"])
    run = F.col("s0") + F.col("s")
    floor = F.least(F.lit(0), F.col("m0"), F.col("s0") + F.col("low"))
    was = run - F.col("step") - F.least(F.lit(0), F.col("m0"), F.coalesce(F.col("s0") + F.min("s").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    e = e.withColumn("depth", run - floor).withColumn("level", F.when(F.col("type") == BEGIN, run - floor).otherwise(was))
    return e.withColumn("effective", (F.col("type") == BEGIN) | (F.col("level") > 0)).drop("chunk", "step", "s", "low", "s0", "m0")


def matched(deep: DataFrame, *, track: str = "track") -> DataFrame:
    """Begin events with end_ts and end_idx (null: unfinished). Within a track and level, begins and ends alternate."""
    w = Window.partitionBy(track, "level").orderBy("ts", "type", "packet_idx")
    e = deep.where("effective").withColumns({"end_ts": F.lead("ts").over(w), "end_idx": F.lead("packet_idx").over(w)})
    return e.where(F.col("type") == BEGIN)


def with_parent(begins: DataFrame, *, track: str = "track") -> DataFrame:
    """Adds parent_idx: the latest begin one level up on the track."""
    w = Window.partitionBy(track, "at").orderBy("ts", "packet_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ups = begins.select(track, F.col("level").alias("at"), "ts", "packet_idx", F.col("packet_idx").alias("up"), F.lit(None).cast("bigint").alias("own"))
    downs = begins.select(track, (F.col("level") - 1).alias("at"), "ts", "packet_idx", F.lit(None).cast("bigint").alias("up"), F.col("packet_idx").alias("own"))
    found = ups.unionByName(downs).withColumn("parent_idx", F.last("up", ignorenulls=True).over(w)).where("own is not null").select(F.col("own").alias("packet_idx"), "parent_idx")
    return begins.join(found, "packet_idx")


def with_path(begins: DataFrame, name: Column, *, track: str = "track", deepest: int | None = None) -> DataFrame:
    """Adds path: names from the root. The ancestors of a begin at level d are the latest begins of levels 1 to d - 1."""
    if deepest is None:
        deepest = begins.agg(F.max("level")).first()[0] or 0
    if deepest > 64:
        return folded_path(begins, name, track=track)
    w = Window.partitionBy(track).orderBy("ts", "packet_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = begins.withColumn("__n", name)
    latest = [F.last(F.when(F.col("level") == j, F.col("__n")), ignorenulls=True).over(w) for j in range(1, deepest + 1)]
    return b.withColumn("path", F.slice(F.array(*latest), 1, F.col("level").cast("int")) if latest else F.array(F.col("__n"))).drop("__n")


def folded_path(begins: DataFrame, name: Column, *, track: str = "track") -> DataFrame:
    """The same for very deep nesting: one fold over each track, in batches of Arrow rows."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql import types as T

    from ..session import ship

    ship(begins.sparkSession)
    b = begins.withColumn("__n", name)
    schema = T.StructType([*b.drop("__n").schema.fields, T.StructField("path", T.ArrayType(T.StringType()))])
    b = b.repartition(track).sortWithinPartitions(track, "ts", "packet_idx")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = object(), []
        for batch in batches:
            paths = []
            for t, level, n in zip(*(batch.column(c).to_pylist() for c in (track, "level", "__n")), strict=True):
                if t != now:
                    now, stack = t, []
                stack[level - 1 :] = [n]
                paths.append(list(stack))
            keep = [i for i, c in enumerate(batch.schema.names) if c != "__n"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(paths, pa.list_(pa.string()))], names=[*(batch.schema.names[i] for i in keep), "path"])

    return b.mapInArrow(fold, schema)

