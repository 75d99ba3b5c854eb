"""Name -> query and name -> oracle SQL for the reference operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import assembly, headings, indexing, ingest, layouts, more, scalars, titles, tree  # noqa: F401  they register their queries
from foliant.plans.base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.ledger(spark, sf_dir)
