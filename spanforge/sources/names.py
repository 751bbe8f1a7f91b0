"""Name maps: JSON files from addresses to names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import parse_int


def name_map(spark: SparkSession, path: str) -> DataFrame:
    """addr, mapped, pos (place in the file), from {"names": {...}} or a flat object. Keys are 0x hex or decimal; bad keys and values that are no strings are dropped; of several keys for one address the last one counts."""
    text = spark.read.text(path, wholetext=True)
    names = F.get_json_object("value", "$.names")
    raw = F.when(names.startswith("{"), names).otherwise(F.col("value"))
    typed = F.from_json(raw, "map<string,variant>")
    found = text.select(F.posexplode(F.coalesce(typed, F.create_map().cast("map<string,variant>"))).alias("pos", "k", "v"))
    found = found.where(F.schema_of_variant("v") == "STRING").select(parse_int(F.col("k")).alias("addr"), F.col("v").cast("string").alias("mapped"), "pos")
    return found.where("addr is not null")
