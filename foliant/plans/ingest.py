"""From tables to a stored corpus: its steps, its audits, the audit bundle and their queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import layout as L
from foliant.plans import headings, more
from foliant.plans.base import query
from foliant.plans.indexing import PAGES, STARTS, TOKENS
from foliant.plans.layouts import BANDS, BLOCKS, _blocks, _pages
from foliant.sources import corpus, sinks, store

_PARENTS = f"""WITH {PAGES}, {STARTS}, g AS (SELECT chapter, level, section_ref, start_page, 'ch' || chapter || ':' || section_ref AS global_id FROM st),
pa AS (SELECT *, CASE level WHEN 1 THEN 'ch' || chapter || ':' || chapter WHEN 2 THEN last_value(CASE WHEN level = 1 THEN global_id END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY start_page, level, section_ref ROWS UNBOUNDED PRECEDING) END AS parent_global_id FROM g)"""


@query("win02_active_parents", f"{_PARENTS} SELECT global_id, parent_global_id FROM pa")
def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.active_parents(corpus.section_starts(corpus.pages(spark, sf_dir))).select("global_id", "parent_global_id")


@query("src06_section_ids", f"{_PARENTS}, n AS (SELECT *, row_number() OVER (ORDER BY start_page, level, section_ref) AS section_id FROM pa) SELECT n.section_id, n.section_ref, n.global_id, p.section_id AS parent_id, coalesce(pg.folio, '') AS start_folio FROM n LEFT JOIN n p ON p.global_id = n.parent_global_id JOIN pg ON pg.pdf_page = n.start_page")
def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.sections(corpus.pages(spark, sf_dir)).select("section_id", "section_ref", "global_id", "parent_id", "start_folio")


@query("src07_token_ids", f"WITH {TOKENS} SELECT row_number() OVER (ORDER BY pdf_page, token_index) AS token_id, pdf_page, CAST(token_index AS INT) AS token_index, text FROM tk")
def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.tokens(spark, sf_dir).select("token_id", "pdf_page", "token_index", "text")


@query("src08_folio_audit", f"WITH {PAGES} SELECT chapter, pdf_page, 'blank_page' AS reason FROM pg WHERE folio IS NULL")
def folio_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a folio. In these tables a page has none where it is blank; gaps of printed folios are win05's."""
    return corpus.pages(spark, sf_dir).where("folio IS NULL").select("chapter", "pdf_page", F.lit("blank_page").alias("reason"))


@query("src09_metadata", f"WITH {PAGES}, {STARTS}, {TOKENS}, {BLOCKS}, {BANDS} SELECT (SELECT count(*) FROM pg) AS n_pages, (SELECT count(*) FROM st) AS n_sections, (SELECT count(*) FROM tk) AS n_tokens, top_cutoff, bottom_cutoff, body_size, body_size - 1 AS footnote_threshold, '{store.FROZEN}' AS built_at FROM bd, md")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row from one-row aggregates; the stored row has the hashes of the tables too."""
    blocks, page = _blocks(spark, sf_dir), corpus.pages(spark, sf_dir)
    counts = [df.agg(F.count("*").alias(name)) for name, df in (("n_pages", page), ("n_sections", corpus.section_starts(page)), ("n_tokens", corpus.tokens(spark, sf_dir)))]
    row = L.bands(blocks, _pages(blocks)).select("top_cutoff", "bottom_cutoff").crossJoin(L.font_mode(blocks).select(F.col("mode").alias("body_size")))
    for one in counts:
        row = row.crossJoin(one)
    return row.select("n_pages", "n_sections", "n_tokens", "top_cutoff", "bottom_cutoff", "body_size", (F.col("body_size") - 1).alias("footnote_threshold"), F.lit(store.FROZEN).alias("built_at"))


def run(spark: SparkSession, sf_dir: str, out: str) -> None:
    """Layout, bands, classes, running heads, pages, folios, sections, tokens, then the store with its metadata."""
    blocks, page = _blocks(spark, sf_dir), corpus.pages(spark, sf_dir)
    places = _pages(blocks)
    band, size = L.bands(blocks, places), L.font_mode(blocks)
    parts = {
        "pages": page,
        "sections": store.sections(page),
        "tokens": store.tokens(spark, sf_dir),
        "folio_audit": folio_audit(spark, sf_dir),
        "header_footer_audit": L.running_heads(blocks, band, places),
        "classification_audit": L.classify(blocks, band, size).where("doubt IS NOT NULL"),
    }
    store.write(spark, out, parts, band, size)


def audit_bundle(spark: SparkSession, sf_dir: str, out: str) -> None:
    """Three ordered outputs beside each other: the text of the pages, the sections as JSON lines, the bounds of the ledger as CSV."""
    more.page_dump(spark, sf_dir).orderBy("pdf_page").select("dump").write.mode("overwrite").text(f"{out}/pages.txt")
    sinks.write_jsonl(more.section_list(spark, sf_dir).select("start_page", "level", "section_ref"), f"{out}/sections.jsonl", ["start_page", "level", "section_ref"])
    sinks.write_csv(headings.ledger_bounds(spark, sf_dir), f"{out}/ledger_bounds.csv", ["start_page", "section_ref"])
