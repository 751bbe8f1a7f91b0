"""A training-corpus pipeline: quality rules, near duplicates, benchmark decontamination, source mix, token ids.

STAGES: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents, whatever further columns there are.

Nulls: a null text has no words, so the first stage drops it. Rows with a null id are told apart from one another. Of several rows with one id the
second stage keeps one; the fourth may write a document up to three times. Empty tables give empty results; without labels only the base test rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import decontaminate, mixing, neardup, quality, tokens
from spanforge.llm.common import shared_dir, table, tokenizer_path, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality.learned_rules(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return quality.judged(quality.stats(rows, doc="row"), rules).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs, share=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_digest(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: Learned rules and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table of the shared folder, read again as the next one's docs."""
    folder, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, folder, f"stage{k + 1}")
    return docs
