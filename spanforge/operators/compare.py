"""Comparison of two executions by ordinal, and of their memory writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, *order: str, range_rows: int = 100_000) -> DataFrame:
    """Adds pos, 0, 1, 2, ... in the order given, which must be total and start with an integer or time column.

    Not one window over everything: rows are numbered inside ranges of the first column, and a range starts at the count of all before it.
    """
    first = order[0]
    lo, hi, n = rows.agg(F.min(F.col(first).cast("bigint")), F.max(F.col(first).cast("bigint")), F.count(F.lit(1))).first()
    width = max(1, ((hi or 0) - (lo or 0) + 1) * range_rows // max(1, n))
    part = F.coalesce(F.floor((F.col(first).cast("bigint") - F.lit(lo or 0)) / width), F.lit(-1)).cast("bigint")
    r = rows.withColumn("__part", part)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = r.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return r.withColumn("__in", inside).join(starts, "__part").withColumn("pos", F.col("__start") + F.col("__in") - 1).drop("__part", "__in", "__start")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both traces by pos: structs a and b, null beyond a trace's end. Both have pos and the same columns."""
    x = a.select("pos", F.struct(*[c for c in a.columns if c != "pos"]).alias("a"))
    y = b.select("pos", F.struct(*[c for c in b.columns if c != "pos"]).alias("b"))
    return x.join(y, "pos", "full")


def execution_error(a: str = "a", b: str = "b", name: str = "name", text: str = "text") -> Column:
    """The first difference of two events by precedence: end of a trace, name (none is empty), annotations; null if they agree. The texts are fixed values."""
    own = lambda side: F.coalesce(F.col(f"{side}.{name}"), F.lit(""))
    return (
        F.when(F.col(a).isNull(), "Trace 1 ended but Trace 2 has more events")
        .when(F.col(b).isNull(), "Trace 2 ended but Trace 1 has more events")
        .when(own(a) != own(b), F.concat(F.lit("Event name mismatch: '"), own(a), F.lit("' vs '"), own(b), F.lit("'")))
        .when(~F.col(f"{a}.{text}").eqNullSafe(F.col(f"{b}.{text}")), "Annotation mismatch")
    )


def memory_error(kind: str, key: str) -> Column:
    """For memory writes (addr, value, pc; null: N/A): end of a trace, address, value, program counter. The texts are fixed values."""
    get = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit("N/A"))
    versus = lambda c: F.concat(F.lit("'"), get("a", c), F.lit("' vs '"), get("b", c), F.lit("'"))
    return (
        F.when(F.col("a").isNull(), f"Trace 1 ended but Trace 2 has more {kind} events")
        .when(F.col("b").isNull(), f"Trace 2 ended but Trace 1 has more {kind} events")
        .when(get("a", "addr") != get("b", "addr"), F.concat(F.lit(f"{kind} {key} mismatch: "), versus("addr")))
        .when(get("a", "value") != get("b", "value"), F.concat(F.lit(f"{kind} value mismatch at {key} "), get("a", "addr"), F.lit(": "), versus("value")))
        .when(get("a", "pc") != get("b", "pc"), F.concat(F.lit(f"PC mismatch for {kind} write at {key} "), get("a", "addr"), F.lit(": "), versus("pc")))
    )


def first_difference(pairs: DataFrame, error: Column) -> DataFrame:
    """At most one row: pos, a, b, error of the least position that differs."""
    return pairs.withColumn("error", error).where("error is not null").orderBy("pos").limit(1)


def context(pairs: DataFrame, error: Column, before: int = 5) -> DataFrame:
    """The pairs from `before` positions ahead of the first difference up to it."""
    at = first_difference(pairs, error).select(F.col("pos").alias("__at"))
    return pairs.join(F.broadcast(at), F.col("pos").between(F.col("__at") - before, F.col("__at"))).withColumnRenamed("__at", "diverges_at")  # one row


def text_diff(pairs: DataFrame) -> DataFrame:
    """pos, side (- or +), entry: entries of the annotation texts in one trace only, as a multiset, for pairs whose texts differ."""
    p = pairs.where("a is not null and b is not null and not a.text <=> b.text")
    x, y = (p.select("pos", F.explode(F.split(F.col(f"{s}.text"), "; ")).alias("entry")) for s in "ab")
    return x.exceptAll(y).select("pos", F.lit("-").alias("side"), "entry").unionByName(y.exceptAll(x).select("pos", F.lit("+").alias("side"), "entry"))


def equal(pairs: DataFrame, error: Column) -> DataFrame:
    """One row: events in each trace, and whether all agree."""
    return pairs.agg(F.count("a").alias("n1"), F.count("b").alias("n2"), F.coalesce(F.bool_and(error.isNull()), F.lit(True)).alias("same"))
