"""Registration of queries with their oracle SQL, and small literal tables both engines can read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def values(rows: list[tuple], names: str) -> str:
    """A VALUES subquery for SQL text; strings have no backslash."""

    def spell(v: object) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(spell, r)) + ')' for r in rows)}) AS t({names}))"


def literal(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """The same rows as a DataFrame."""
    return spark.createDataFrame(rows, ddl)
