"""The corpus as stored tables: dense ids, sorted sinks, one row of metadata, opening with a check of the schema.

A store is a folder of Parquet tables. Its metadata are emptied before a build and written after it,
so a build that was lost midway does not open.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.session import table
from foliant.sources import corpus, sinks

#: Fixed value: the time of every build, so that builds agree byte for byte.
FROZEN = "1970-01-01T00:00:00Z"
VERSION = "1"
#: Columns and sort keys of the stored tables.
SCHEMAS = {
    "pages": ("chapter int, pdf_page bigint, ordinal int, folio string, folio_style string, n_chars bigint", ["pdf_page"]),
    "sections": ("section_id bigint, section_ref string, global_id string, level int, chapter int, parent_id bigint, start_page bigint, end_page bigint, start_folio string", ["section_id"]),
    "tokens": ("token_id bigint, pdf_page bigint, token_index int, text string, norm string, lemma string, block_type string", ["token_id"]),
    "folio_audit": ("chapter int, pdf_page bigint, reason string", ["pdf_page"]),
    "header_footer_audit": ("pdf_page bigint, block int, band string, reason string", ["pdf_page", "block"]),
    "classification_audit": ("pdf_page bigint, block int, block_type string, doubt string", ["pdf_page", "block"]),
}
METADATA = "id int, n_pages bigint, n_sections bigint, n_tokens bigint, bands string, body_size double, footnote_threshold double, version string, built_at string, hashes map<string,string>"


def _before_runs(counts: DataFrame) -> DataFrame:
    """(run, before) from (run, n): what lies before each run. One row for RUN_PAGES pages meets in one task."""
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def dense_ids(rows: DataFrame, page: str, order: list[str], name: str) -> DataFrame:
    """rows with their rank by (page, order...) from 1 as column name; order makes it total, pages are not null."""
    held = rows.withColumn("run", corpus.run_of(F.col(page)))
    inside = F.row_number().over(Window.partitionBy("run").orderBy(page, *order))
    before = _before_runs(held.groupBy("run").agg(F.count("*").alias("n")))
    return held.withColumn("at", inside).join(before, "run").withColumn(name, F.col("before") + F.col("at")).drop("run", "at", "before")


def _carried(rows: DataFrame, value: Column) -> DataFrame:
    """rows (chapter, start_page, level) with held: the last value of the chapter up to each row, carried from run to run."""
    rows = rows.withColumn("run", corpus.run_of(F.col("start_page"))).withColumn("own", value)
    earlier = Window.partitionBy("chapter").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("chapter", "run").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("start_page"))).alias("last"))
    before = runs.select("chapter", "run", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    by = Window.partitionBy("chapter", "run").orderBy("start_page", "level", "section_ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = rows.withColumn("here", F.last("own", ignorenulls=True).over(by)).join(before, ["chapter", "run"])
    return here.withColumn("held", F.coalesce("here", "carried")).drop("run", "own", "here", "carried")


def active_parents(starts: DataFrame) -> DataFrame:
    """starts (chapter, level, section_ref, start_page) with global_id and parent_global_id.

    A chapter has no parent, a section its chapter, a subsection the section that is open where it
    starts; a level below takes its parent from the first two numbers of its own reference.
    """
    of = lambda ref: F.concat(F.lit("ch"), F.col("chapter").cast("string"), F.lit(":"), ref)
    rows = _carried(starts.withColumn("global_id", of(F.col("section_ref"))), F.when(F.col("level") == 1, F.col("global_id")))
    parent = F.when(F.col("level") == 1, of(F.col("chapter").cast("string"))).when(F.col("level") == 2, F.col("held")).when(F.col("level") == 3, of(F.substring_index("section_ref", ".", 2)))
    return rows.withColumn("parent_global_id", parent).drop("held")


def section_ids(rows: DataFrame) -> DataFrame:
    """rows of active_parents with section_id and parent_id; a parent that is not among them is an error."""
    ids = dense_ids(rows, "start_page", ["level", "section_ref"], "section_id")
    known = ids.select(F.col("global_id").alias("parent_global_id"), F.col("section_id").alias("found"))
    lost = F.raise_error(F.concat(F.lit("the parent of section "), "global_id", F.lit(" is not among the sections: "), "parent_global_id")).cast("bigint")
    parent = F.when(F.col("parent_global_id").isNotNull(), F.coalesce("found", lost))
    return ids.join(known, "parent_global_id", "left").withColumn("parent_id", parent).drop("found")


def sections(page: DataFrame) -> DataFrame:
    """The stored sections of pages, with the folio of the first page, empty if it has none."""
    ends = corpus.sections(page).select("global_id", "end_page")
    folios = page.select(F.col("pdf_page").alias("start_page"), F.coalesce("folio", F.lit("")).alias("start_folio"))
    return section_ids(active_parents(corpus.section_starts(page))).join(ends, "global_id").join(folios, "start_page")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with token_id, their rank by page and index.

    Only the number of tokens of each page is ranked; a token adds its index, so tokens are not shuffled.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pdf_page"), T.pinned(corpus.token_rows(F.col("text"))).alias("rows"))
    sizes = docs.select("pdf_page", F.coalesce(F.size("rows"), F.lit(0)).alias("n"), corpus.run_of(F.col("pdf_page")).alias("run")).where("n > 0")
    before = _before_runs(sizes.groupBy("run").agg(F.sum("n").alias("n")))
    earlier = Window.partitionBy("run").orderBy("pdf_page").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("inside", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(before, "run").select("pdf_page", (F.col("before") + F.col("inside")).alias("first"))
    return corpus.tokens(spark, sf_dir).join(first, "pdf_page").select((F.col("first") + F.col("token_index") + 1).alias("token_id"), "pdf_page", "token_index", "text", "norm", "lemma", "block_type")


def _shaped(df: DataFrame, ddl: str) -> DataFrame:
    return df.select(*(F.col(name).cast(kind).alias(name) for name, kind in (c.strip().split(" ", 1) for c in ddl.split(", "))))


def write(spark: SparkSession, out: str, parts: dict[str, DataFrame], bands: DataFrame, body_size: DataFrame) -> None:
    """All tables of SCHEMAS, each ranged and sorted by its keys, then the metadata."""
    spark.createDataFrame([], METADATA).write.mode("overwrite").parquet(f"{out}/metadata")
    for name, (ddl, keys) in SCHEMAS.items():
        sinks.write_sorted(_shaped(parts[name], ddl), f"{out}/{name}", keys)
    stored = {name: spark.read.parquet(f"{out}/{name}") for name in SCHEMAS}
    hashes = {name: sinks.content_hash(df).first()[0] for name, df in stored.items()}
    band = bands.select("top_cutoff", "bottom_cutoff", "mode", "top_peak", "bottom_peak").first().asDict()
    size = body_size.first()["mode"]
    row = (1, *(stored[t].count() for t in ("pages", "sections", "tokens")), json.dumps(band, sort_keys=True), size, None if size is None else size - 1.0, VERSION, FROZEN, hashes)
    spark.createDataFrame([row], METADATA).coalesce(1).write.mode("overwrite").parquet(f"{out}/metadata")


def read(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of a finished store; one that is unfinished, of another version or of other columns is an error."""
    found = spark.read.schema(METADATA).parquet(f"{out}/metadata").take(2)
    if len(found) != 1 or found[0]["version"] != VERSION:
        raise ValueError(f"{out} is no finished corpus of version {VERSION}")
    tables = {name: spark.read.parquet(f"{out}/{name}") for name in SCHEMAS}
    for name, df in tables.items():
        want = [tuple(c.strip().split(" ", 1)) for c in SCHEMAS[name][0].split(", ")]
        if df.dtypes != want:
            raise ValueError(f"{out}/{name} has columns {df.dtypes}, not {want}")
    return {**tables, "metadata": spark.read.schema(METADATA).parquet(f"{out}/metadata")}
