"""A corpus pipeline of five operators. Each stage takes (spark, docs, sf_dir) and returns a DataFrame.

The quality rules drop documents, one document of each near-duplicate group stays, documents that
contain a benchmark item go, sources are mixed to their targets, and what is left is dealt to
shards. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontaminate, mixing, neardup, quality, sharding
from foliant.llm.common import documents, fresh, written

N_SHARDS = 24


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judged(docs)
    verdict = judged.columns[-1]
    return judged.where(judged[verdict]["kept"]).drop(verdict)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, documents(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    slots, _ = sharding.build_map(docs, N_SHARDS)
    return sharding.assign(docs, slots)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", source_mix),
    ("sharding", shards),
]

#: Near-duplicate search is not a SQL query; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), fresh(docs, name.replace(" ", "_")))
    return STAGES[-1][1](spark, docs, sf_dir)
