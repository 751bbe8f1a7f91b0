"""Track names and the discovery of tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def named_as_of(events: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Adds track_name: that of the latest descriptor of the track before the event in the file, else track_<uuid>.

    events: track, packet_idx; descriptors: track, packet_idx, name.
    """
    w = Window.partitionBy("track").orderBy("packet_idx", "__ev").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = events.withColumns({"__name": F.lit(None).cast("string"), "__ev": F.lit(1)})
    d = descriptors.select("track", "packet_idx", F.col("name").alias("__name"), F.lit(0).alias("__ev"))
    u = e.unionByName(d, allowMissingColumns=True).withColumn("track_name", F.last("__name", ignorenulls=True).over(w))
    return u.where("__ev = 1").withColumn("track_name", F.coalesce("track_name", F.concat(F.lit("track_"), F.col("track").cast("string")))).drop("__name", "__ev")


def last_names(descriptors: DataFrame) -> DataFrame:
    """track, name: the whole file's last descriptor of each track."""
    return descriptors.groupBy("track").agg(F.max_by("name", "packet_idx").alias("name"))


def chosen(events: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Events of the included tracks (none given: all), without those of the excluded ones."""
    e = events.where(F.col("track_name").isin(*include)) if include else events
    return e.where(~F.col("track_name").isin(*exclude)) if exclude else e


def first_named(events: DataFrame, most: int = 10) -> DataFrame:
    """The first `most` named events of each track."""
    w = Window.partitionBy("track").orderBy("packet_idx")
    return events.where(F.coalesce("name", F.lit("")) != "").withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= most)


def execution_track(events: DataFrame, descriptors: DataFrame, name: str = "Execution", prefix: str = "Exec@") -> DataFrame:
    """One row, track: the first-described track with that (last) name; else, of tracks whose first ten named events have one with the prefix, the one that comes first.

    Track 0 counts as missing. No row: there is none.
    """
    first = descriptors.groupBy("track").agg(F.min("packet_idx").alias("at"), F.max_by("name", "packet_idx").alias("name"))
    by_name = first.where((F.col("name") == name) & (F.col("track") != 0)).select("track", "at", F.lit(0).alias("rank"))
    seen = first_named(events).groupBy("track").agg(F.min("packet_idx").alias("at"), F.bool_or(F.col("name").contains(prefix)).alias("some"))
    by_events = seen.where(F.col("some") & (F.col("track") != 0)).select("track", "at", F.lit(1).alias("rank"))
    return by_name.unionByName(by_events).orderBy("rank", "at").limit(1).select("track")


def memory_track(events: DataFrame, descriptors: DataFrame, name: str, fallback: int) -> DataFrame:
    """One row, track: by name; else the fixed fallback id, if it is described and has an instant event."""
    first = descriptors.groupBy("track").agg(F.min("packet_idx").alias("at"), F.max_by("name", "packet_idx").alias("name"))
    by_name = first.where(F.col("name") == name).select("track", "at", F.lit(0).alias("rank"))
    used = events.where((F.col("type") == 3) & (F.col("track") == fallback)).select("track").distinct()
    other = first.join(used, "track", "left_semi").where(F.col("track") == fallback).select("track", "at", F.lit(1).alias("rank"))
    return by_name.unionByName(other).orderBy("rank", "at").limit(1).select("track")
