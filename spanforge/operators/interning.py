"""Interned strings: writing them with incremental dictionaries, and resolving them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLEARED, NEEDS = 1, 2
KIND_NAMES = {"event_names": "EventName", "debug_annotation_names": "DebugAnnotationName", "debug_annotation_string_values": "DebugAnnotationStringValue"}


def encoded(values: DataFrame, keys: tuple[str, ...] = ("seq",)) -> DataFrame:
    """values: keys, packet_idx, pos, value. Adds iid (dense, by first occurrence) and is_new (this row carries the entry)."""
    at = F.struct("packet_idx", "pos")
    first = values.groupBy(*keys, "value").agg(F.min(at).alias("first"))
    first = first.withColumn("iid", F.row_number().over(Window.partitionBy(*keys).orderBy("first")).cast("bigint"))
    return values.join(first, [*keys, "value"]).withColumn("is_new", at == F.col("first")).drop("first")


def flags(packets: DataFrame, keys: tuple[str, ...] = ("seq",), clear_on: str = "first_interning") -> DataFrame:
    """packets: keys, packet_idx, interns (boolean). Adds sequence_flags: NEEDS where strings are interned, CLEARED on the first such packet or, with "first_packet", on the first of all."""
    order = Window.partitionBy(*keys).orderBy("packet_idx")
    nth = F.sum(F.col("interns").cast("int")).over(order) if clear_on == "first_interning" else F.row_number().over(order)
    cleared = (nth == 1) & F.col("interns") if clear_on == "first_interning" else nth == 1
    return packets.withColumn("sequence_flags", F.when(F.col("interns"), NEEDS).otherwise(0) + F.when(cleared, CLEARED).otherwise(0))


def generations(packets: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds gen (counts resets of the sequence so far) and valid. A dropped packet resets to invalid, a cleared one to valid; cleared wins on one packet."""
    w = Window.partitionBy(seq).orderBy("packet_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reset = F.col("dropped") | F.col("cleared")
    return packets.withColumns({"gen": F.sum(reset.cast("bigint")).over(w), "valid": F.coalesce(F.last(F.when(reset, F.col("cleared")), ignorenulls=True).over(w), F.lit(False))})


def missing_text(table: Column, iid: Column) -> Column:
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KIND_NAMES.items() for x in kv]), table)
    return F.concat(F.lit("<missing "), kind, F.lit(" iid="), iid.cast("string"), F.lit(">"))


def resolved(lookups: DataFrame, entries: DataFrame, packets: DataFrame, *, seq: str = "seq", strict: bool = False) -> DataFrame:
    """An as-of lookup: each (seq, packet_idx, table, iid) gets the latest entry of its dictionary generation, in or before its packet.

    lookups: seq, packet_idx, table, iid, inline (text or null) and any more; entries: seq, packet_idx, pos, table, iid, value.
    packets: seq, packet_idx, dropped, cleared, needs. Text is null where a packet needs a state that is not valid, a marked text where the id is unknown.
    strict: packets without a sequence id (null or 0) are left unresolved, as one dialect has it.
    """
    p = generations(packets, seq).select(seq, "packet_idx", "gen", "valid", "needs")
    w = Window.partitionBy(seq, "gen", "table", "iid").orderBy("packet_idx", "__pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = entries.join(p, [seq, "packet_idx"]).select(seq, "gen", "table", "iid", "packet_idx", F.col("pos").alias("__pos"), F.col("value").alias("__entry"))
    asked = lookups.join(p, [seq, "packet_idx"]).withColumns({"__pos": F.lit(2**31 - 1), "__entry": F.lit(None).cast("string")})
    u = asked.unionByName(e, allowMissingColumns=True).withColumn("__found", F.last("__entry", ignorenulls=True).over(w)).where(F.col("__pos") == 2**31 - 1)
    text = F.when(F.col("iid").isNull(), F.col("inline")).when(F.col("needs") & ~F.col("valid"), F.lit(None)).otherwise(F.coalesce("__found", missing_text(F.col("table"), F.col("iid"))))
    if strict:
        text = F.when(F.coalesce(F.col(seq), F.lit(0)) == 0, F.col("inline")).otherwise(text)
    return u.withColumn("text", text).drop("__pos", "__entry", "__found", "gen", "valid", "needs")
