"""Trace views of the test tables: events as packets, orders and line items as frames, flows, writes and executions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import annotation_text, hex_upper
from ..operators.compare import numbered

LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packet_idx, track, ts (ns), type, name, value, k."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("signup", "view"), 1).when(F.col("event_type").isin("purchase", "error"), 2).otherwise(3)
    return e.select(
        F.col("event_id").alias("packet_idx"), F.col("user_id").alias("track"), (micros(F.col("ts")) * 1000).alias("ts"), kind.alias("type"),
        F.col("event_type").alias("name"), "value", F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("bigint").alias("k"),
    )


def track_named(e: DataFrame) -> DataFrame:
    return e.withColumn("track_name", F.concat(F.lit("user_"), F.col("track").cast("string")))


def descriptors(e: DataFrame) -> DataFrame:
    """Every signup renames its track."""
    return e.where("name = 'signup'").select("track", "packet_idx", F.concat(F.lit("user_"), F.col("track").cast("string"), F.lit("_v"), F.col("k").cast("string")).alias("name"))


def sequences(e: DataFrame) -> DataFrame:
    """Packets with sequence state: seq, packet_idx, cleared, dropped, needs."""
    return e.select((F.col("track") % 4).alias("seq"), "packet_idx", (F.col("k") % 37 == 0).alias("cleared"), (F.col("k") % 41 == 0).alias("dropped"), (F.col("k") % 2 == 0).alias("needs"), "k", "name")


def execution(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """pos, name, text, pc, opcode of an execution; b has some quantities raised and the tail cut off."""
    li = numbered(table(spark, sf_dir, "lineitem"), *LINE)
    qty = F.col("l_quantity").cast("bigint")
    if which == "b":
        qty = qty + F.when(F.col("l_orderkey") % 1009 == 17, 1).otherwise(0)
        li = li.where(F.col("l_orderkey") <= table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey") - 5).scalar())
    pc = hex_upper(F.col("l_partkey"))
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("qty", qty.cast("string")), ("pc", pc), ("opcode", F.col("l_returnflag")))])
    return li.select("pos", F.concat(F.lit("Exec@"), hex_upper(F.col("l_partkey"), 6)).alias("name"), annotation_text(entries).alias("text"), pc.alias("pc"), F.col("l_returnflag").alias("opcode"))


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory writes with texts as a tracer prints them: offset inside, address or addr outside, some decimal."""
    li = table(spark, sf_dir, "lineitem")
    at = F.when(F.col("l_suppkey") % 2 == 0, hex_upper(F.col("l_partkey"))).otherwise(F.col("l_partkey").cast("string"))
    inner, named = F.col("l_linestatus") == "F", F.col("l_returnflag") == "N"
    return li.select(
        F.col("l_orderkey").alias("packet_idx"), F.when(inner, at).alias("offset"), F.when(~inner & named, at).alias("address"), F.when(~inner & ~named, at).alias("addr"),
        hex_upper(F.col("l_suppkey") * 65537 + F.col("l_partkey")).alias("value"), hex_upper(F.col("l_partkey") % 65536, 4).alias("pc"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("string")).alias("size"),
        *LINE,
    )


def program_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").bitwiseAND(F.lit(65535)).alias("pc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
