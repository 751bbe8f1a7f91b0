"""Program counters: extraction from raw bytes, regions, hot spots, containing functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rawbytes import matches, number_at

#: What stands around a program counter in a serialized event, and the bases tried in this order.
PC_NAME, BEFORE, NEXT = b"\x52\x02\x70\x63", 0x38, 0x3C
BASES = (0xE0000, 0xC0000, 0xA0000, 0x80000, 0x40000, 0x00000)


def counters_in(files: DataFrame, content: str = "content") -> DataFrame:
    """pc of each marked place: two little-endian bytes between the marks, three bytes before the name."""
    e = matches(files, PC_NAME, content, 4).where(F.length("before") == 4)
    byte = lambda i: F.hex(F.substring("before", i + 1, 1))
    e = e.where((byte(0) == f"{BEFORE:02X}") & (byte(3) == f"{NEXT:02X}"))
    return e.withColumn("pc", number_at(F.col("before"), F.lit(1), 2)).drop("before", "after")


def histogram(pcs: DataFrame, at: str = "position") -> DataFrame:
    """pc, count, first_pos (what decides between equal counts)."""
    return pcs.groupBy("pc").agg(F.count(F.lit(1)).alias("count"), F.min(at).alias("first_pos"))


def full_address(raw: Column, bases: tuple[int, ...] = BASES, offsets_below: int = 0x20000, space: int = 0x100000) -> Column:
    """An address above 0x80000 stays; a small one gets the first base that keeps it in the space; others are null."""
    fit = F.coalesce(*[F.when(raw + b < space, raw + b) for b in bases])
    return F.when(raw > 0x80000, raw).when(raw < offsets_below, fit)


def by_region(counts: DataFrame) -> DataFrame:
    """addr, count, first_pos: counts of equal full addresses together."""
    return counts.withColumn("addr", full_address(F.col("pc"))).where("addr is not null").groupBy("addr").agg(F.sum("count").alias("count"), F.min("first_pos").alias("first_pos"))


def totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique"))


def hottest(counts: DataFrame, top: int = 20) -> DataFrame:
    """rank, addr, count, percent, cumulative of the most frequent; of equal counts the first seen leads."""
    all_ = counts.agg(F.sum("count").alias("total"))
    best = counts.orderBy(F.desc("count"), "first_pos", "addr").limit(top)  # what follows is over `top` rows
    w = Window.orderBy(F.desc("count"), "first_pos", "addr")
    best = best.withColumn("rank", F.row_number().over(w)).withColumn("sum_to", F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = all_.scalar()
    return best.select("rank", "addr", "count", (F.col("count") / total * 100).alias("percent"), (F.col("sum_to") / total * 100).alias("cumulative"))


def containing(addresses: DataFrame, functions: DataFrame, width: int = 4096) -> DataFrame:
    """Adds function and distance for the function (start, end, name) with start <= addr < end; of several the latest start.

    A range join by buckets of `width` addresses: a function stands in each bucket that it touches.
    """
    f = functions.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))).select("bucket", "start", "end", "name")
    a = addresses.withColumn("bucket", F.floor(F.col("addr") / width))
    hit = a.select("addr", "bucket").distinct().join(f, "bucket").where((F.col("addr") >= F.col("start")) & (F.col("addr") < F.col("end")))
    best = hit.groupBy("addr").agg(F.max(F.struct("start", "name")).alias("b"))
    return addresses.join(best, "addr", "left").select(*addresses.columns, F.col("b.name").alias("function"), (F.col("addr") - F.col("b.start")).alias("distance"))
