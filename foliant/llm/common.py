"""What several operators of this subpackage share: words, row keys and tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators and the word of every contract.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The same for DuckDB.
SQL_SPACE = r"[\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; none for a null or blank text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def pinned(column: Column) -> Column:
    """The same column, which Catalyst does not copy into filters.

    A filter inferred from a join or an explode is otherwise pushed below the projection that makes
    an array, and a lambda then computes its whole source again for each element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a local one; a cluster must set it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}/{name}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return _path(spark, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors.

    The shuffle files of the write are dropped as soon as it is done, as nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again."""
    for table in tables:
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            _delete(table.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written."""
    _delete(spark, _path(spark, ""))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, for working columns beside unknown ones."""
    taken, out = {c.lower() for c in df.columns}, name
    while out.lower() in taken:
        out = f"_{out}"
    return out


def hash60(seed: str | int, *columns: Column) -> Column:
    """60 bits of an MD5 of the seed and the columns as text (null: empty): the same in any engine."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def int_array(values) -> Column:
    """A constant array of integers, folded to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few driver-side rows as a DataFrame, without RDD code."""
    import json

    names = [c.strip().split(" ")[0] for c in ddl.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in ddl.split(','))}>>")))
