"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source has the same expected number of copies, target / source size. Documents of a source stand
in a fixed order; the expected copies are prefix-summed, one random offset per source is added, and a document is taken
once for each integer boundary that its interval crosses. The order is by size class, block, size and id, so that the sample takes
from all sizes evenly and the words taken come near the target.

A prefix sum over one source would put a hot source into one task. So ranks come in steps, each over what the one before has summed: size classes of a
source, groups of `cell_group` blocks of a size class, blocks (cells) of a group, rows of a cell. The number of blocks of a size class grows with its
count, so that a cell holds about `cell_rows` rows however large the source, and no step sees more than a group.

Nulls: a null source is a source (the last), a null text has size 0, a null id is ordered first. A source of size 0 has target 0; its
documents are not taken. Rows repeated in full are ranked one after the other. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, shared_dir, written

#: Size classes in an octave of words; a class is then narrower than 9 %.
PER_OCTAVE = 8


def size_class(size: str) -> Column:
    return F.when(F.col(size) > 0, F.floor(F.log2(F.col(size).cast("double")) * PER_OCTAVE + 1e-9)).otherwise(-1).cast("int")


def offset(source: str, seed: int) -> Column:
    """In [0, 1), from the source's key and the seed; reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(source))), 1, 8), 16, 10).cast("double") / 4294967296.0


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """From src ("=" and the name, or "null") and its size (a row each): target, at most `most` times the size; what is above is reshared by weight.

    With sources ordered by most * size / weight, those capped come first: a source is capped if the level that the
    rest would get, once all before it are capped, is above its own bound.
    """
    order = Window.orderBy(F.col("src").startswith("=").desc(), "src")  # a row a source: an aggregate, not documents
    w = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = Window.orderBy("bound", F.col("src").startswith("=").desc(), "src")
    every = Window.partitionBy()
    s = sizes.withColumn("w", w).withColumn("bound", most * F.col("source_size") / F.col("w"))
    s = s.withColumns({"total": F.sum("source_size").over(every), "all_w": F.sum("w").over(every), "size_to": F.sum("source_size").over(by), "w_to": F.sum("w").over(by)})
    rest, rest_w = F.col("total") - most * (F.col("size_to") - F.col("source_size")), F.col("all_w") - (F.col("w_to") - F.col("w"))
    s = s.withColumn("capped", (most * F.col("source_size")).cast("decimal(30,0)") * rest_w.cast("decimal(8,0)") <= F.col("w").cast("decimal(8,0)") * rest.cast("decimal(30,0)"))
    held = F.sum(F.when(F.col("capped"), most * F.col("source_size")).otherwise(0)).over(every)
    free_w = F.sum(F.when(~F.col("capped"), F.col("w")).otherwise(0)).over(every)
    target = F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(((F.col("total") - held) * F.col("w")).cast("double") / free_w.cast("double"))
    return s.select("src", "source_size", target.alias("target"))


def sized(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def plan(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = (), weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7, cell_rows: int = 1000, cell_group: int = 1000, small_classes: int = 500_000) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, copies, and the columns to carry (as a struct `row`)."""
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    name = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))  # never null, so that keys can be joined and dealt alike
    d = docs.select(F.col(doc).alias("doc_id"), name.alias("src"), sized(docs, text).alias("size"), *row).withColumn("cls", size_class("size"))
    # Words are counted once: what is known of the documents, without their texts, is a table; rows that are carried get it again.
    counts = written(d.select("doc_id", "src", "size", "cls"), shared_dir(docs.sparkSession), "sizes")
    d = d if carry else counts
    classes = counts.groupBy("src", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    classes = written(classes, shared_dir(docs.sparkSession), "classes")
    few = classes.limit(small_classes + 1).count() <= small_classes
    targets = source_targets(classes.groupBy("src").agg(F.sum("s").alias("source_size")), weights, most)
    info = classes.join(targets, "src").select("src", "cls", "source_size", "target", F.ceil(F.col("n") / cell_rows).cast("bigint").alias("blocks"))
    info = F.broadcast(info) if few else info  # else what is carried is dealt out by (src, cls), where a hot source's class is large
    hashed = F.coalesce(F.col("doc_id"), F.lit(-1)).cast("bigint") % 2147483648 * 2654435761 % 4294967296
    block = F.pmod(hashed, F.col("blocks")).alias("blk")
    cells = counts.join(info, ["src", "cls"]).select("src", "cls", block).groupBy("src", "cls", "blk").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("grp", F.floor(F.col("blk") / cell_group))

    def ahead(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
        """Adds before: the sum of n over what stands ahead under the same keys."""
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))

    groups = ahead(cells.groupBy("src", "cls", "grp").agg(F.sum("n").alias("n")), ["src", "cls"], "grp")
    ofclass = ahead(classes, ["src"], "cls").select("src", "cls", F.col("before").alias("b0"))
    groups = groups.join(F.broadcast(ofclass) if few else ofclass, ["src", "cls"]).select("src", "cls", "grp", (F.col("before") + F.col("b0")).alias("b1"))
    cells = ahead(cells, ["src", "cls", "grp"], "blk").join(groups, ["src", "cls", "grp"]).select("src", "cls", "blk", (F.col("before") + F.col("b1")).alias("before"))
    # The last join and the window deal out by the same keys: what is carried is shuffled once.
    d = d.join(info, ["src", "cls"]).withColumn("blk", block).join(cells, ["src", "cls", "blk"])
    tie = [F.xxhash64("row")] if carry else []  # of several texts with one id and size, always the same one
    at = F.col("before") + F.row_number().over(Window.partitionBy("src", "cls", "blk").orderBy("size", "doc_id", *tie))
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    u = offset("src", seed)
    d = d.withColumn("at", at.cast("double"))
    copies = F.least(F.floor(F.col("at") * f + u) - F.floor((F.col("at") - 1) * f + u), F.lit(most)).cast("bigint")
    return d.select("doc_id", "size", "source_size", "target", copies.alias("copies"), *(["row"] if carry else []))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix: each document as often as it is taken, with the columns of docs."""
    d = plan(docs, carry=tuple(docs.columns), **options).where("copies > 0")
    return d.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
