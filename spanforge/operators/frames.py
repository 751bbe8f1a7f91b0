"""Frame timelines, flows, counters: reading what the trace schema can hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a jank type.
JANK = {
    1: "NONE", 2: "SF_SCHEDULING", 4: "PREDICTION_ERROR", 8: "DISPLAY_HAL", 16: "SF_CPU_DEADLINE_MISSED", 32: "SF_GPU_DEADLINE_MISSED", 64: "APP_DEADLINE_MISSED", 128: "BUFFER_STUFFING",
    256: "UNKNOWN", 512: "SF_STUFFING", 1024: "DROPPED", 2048: "NON_ANIMATING", 4096: "APP_RESYNCED_JITTER", 8192: "DISPLAY_NOT_ON", 16384: "DISPLAY_MODE_CHANGE_IN_PROGRESS", 32768: "DISPLAY_POWER_MODE_CHANGE_IN_PROGRESS",
}


def jank_labels(bits: Column) -> Column:
    """The set bits' names, lowest first, as an array."""
    return F.filter(F.array(*[F.when(bits.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for b, n in JANK.items()]), lambda x: x.isNotNull())


def expected_and_actual(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """token, expected_ts, actual_ts, late_ns, by token; tokens on one side only are kept."""
    e, a = expected.groupBy("token").agg(F.min("ts").alias("expected_ts")), actual.groupBy("token").agg(F.min("ts").alias("actual_ts"))
    return e.join(a, "token", "full").withColumn("late_ns", F.col("actual_ts") - F.col("expected_ts"))


def ended(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Starts with end_ts: the first end of the same cookie at or after the start."""
    w = Window.partitionBy("cookie").orderBy("ts", "__end").rowsBetween(0, Window.unboundedFollowing)
    u = starts.withColumn("__end", F.lit(0)).unionByName(ends.select("cookie", "ts", F.lit(1).alias("__end")), allowMissingColumns=True)
    return u.withColumn("end_ts", F.first(F.when(F.col("__end") == 1, F.col("ts")), ignorenulls=True).over(w)).where("__end = 0").drop("__end")


def flow_steps(events: DataFrame) -> DataFrame:
    """events: flow_id, ts, packet_idx, terminating. Adds step (0: source) and role; the last or a terminating one is the sink."""
    w = Window.partitionBy("flow_id").orderBy("ts", "packet_idx")
    e = events.withColumns({"step": F.row_number().over(w) - 1, "__next": F.lead("packet_idx").over(w)})
    role = F.when(F.col("step") == 0, "source").when(F.col("__next").isNull() | F.col("terminating"), "sink").otherwise("step")
    return e.withColumn("role", role).drop("__next")


def counter_fields(value: Column) -> dict[str, Column]:
    """A counter value as it is written: counter_value if it is a whole number in range, else double_counter_value."""
    whole = (value == F.floor(value)) & (F.abs(value) < 9.2e18)
    return {"counter_value": F.when(whole, value.cast("bigint")), "double_counter_value": F.when(~whole | whole.isNull(), value)}


def counter_series(samples: DataFrame) -> DataFrame:
    """samples: track, ts, packet_idx, value. Adds until_ts and delta to the sample before."""
    w = Window.partitionBy("track").orderBy("ts", "packet_idx")
    return samples.withColumns({"until_ts": F.lead("ts").over(w), "delta": F.col("value") - F.lag("value").over(w)})


def extra_counters(events: DataFrame) -> DataFrame:
    """One row per extra counter of an event: arrays of tracks and values, zipped by place."""
    z = F.explode(F.arrays_zip("extra_counter_track_uuids", "extra_counter_values")).alias("z")
    return events.select("packet_idx", z).select("packet_idx", F.col("z.extra_counter_track_uuids").alias("track"), F.col("z.extra_counter_values").alias("value"))
