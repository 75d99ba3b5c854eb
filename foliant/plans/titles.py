"""Queries of headings and titles, over lines of documents with fonts and sizes by rule, three lines a block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import titles as L
from foliant.plans.base import query
from foliant.session import table

SECTION = r"^§ \d+\.\d{2}\s*"
STYLES = [L.Style(0, "Sans-Bold", 24.0, r"^CHAPTER\s+\d+", (14.0, 24.0), 3, False, None), L.Style(1, "Sans-Bold", 12.0, SECTION, (12.0,), 2, True, SECTION)]

SPANS = """l0 AS (SELECT doc_id AS pdf_page, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
l1 AS (SELECT *, i % 12 = 1 AS mark, pdf_page % 2 = 0 AS chap FROM l0),
sp AS (SELECT pdf_page, i // 3 AS block, i % 3 AS line, chap, mark, CASE WHEN mark AND chap THEN 'CHAPTER ' || (i // 12 + 1) WHEN mark THEN '§ 1.02 ' || raw ELSE raw END AS text, mark OR length(raw) % 3 <> 0 AS bold FROM l1),
ok AS (SELECT *, bold AND regexp_matches(text, '\\S') AND NOT (mark AND NOT chap) AS good FROM sp)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pdf_page"), F.posexplode(F.split("text", "\n", -1)).alias("i", "raw"))
    i, chapter = F.col("i"), F.col("pdf_page") % 2 == 0
    mark = i % 12 == 1
    text = F.when(mark & chapter, F.concat(F.lit("CHAPTER "), (F.floor(i / 12) + 1).cast("string"))).when(mark, F.concat(F.lit("§ 1.02 "), "raw")).otherwise(F.col("raw"))
    bold = mark | (F.length("raw") % 3 != 0)
    size = F.when(~bold, 10.98).when(mark & chapter, 24.0).when(chapter, 14.0).otherwise(12.0)
    return rows.select("pdf_page", F.floor(i / 3).alias("block"), (i % 3).alias("line"), F.lit(0).alias("span"), F.lit(True).alias("is_text"), text.alias("text"), F.when(bold, "Sans-Bold").otherwise("Serif").alias("font"), size.alias("size"))


@query("prj07_chapter_headings", f"WITH {SPANS} SELECT pdf_page, block, line, text FROM sp WHERE mark AND chap")
def chapter_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct(F.array(F.struct("text", "font", "size")).alias("spans"))
    return _spans(spark, sf_dir).where(L.is_mark(line, STYLES[0])).select("pdf_page", "block", "line", "text")


@query("prj06_titles", f"""WITH {SPANS}, wh AS (SELECT pdf_page, block, bool_and(good) AS whole, list(text ORDER BY line) AS texts FROM ok GROUP BY 1, 2),
br AS (SELECT m.pdf_page, m.block, m.line, m.chap, m.text, coalesce(min(CASE WHEN NOT o.good THEN o.line END), 99) AS stop, list(o.text ORDER BY o.line) FILTER (o.line IS NOT NULL) AS below FROM ok m LEFT JOIN ok o ON o.pdf_page = m.pdf_page AND o.block = m.block AND o.line > m.line WHERE m.mark GROUP BY ALL),
jo AS (SELECT br.*, stop = 99 AS open, a.texts AS ta, coalesce(a.whole, false) AS wa, b.texts AS tb, coalesce(b.whole, false) AS wb, c.texts AS tc, coalesce(c.whole, false) AS wc FROM br LEFT JOIN wh a ON a.pdf_page = br.pdf_page AND a.block = br.block + 1 LEFT JOIN wh b ON b.pdf_page = br.pdf_page AND b.block = br.block + 2 LEFT JOIN wh c ON c.pdf_page = br.pdf_page AND c.block = br.block + 3),
pa AS (SELECT pdf_page, block, line, chap, list_concat(CASE WHEN chap THEN [] ELSE [regexp_replace(text, '^§ \\d+\\.\\d{{2}}\\s*', '')] END, CASE WHEN below IS NULL THEN [] ELSE below[1:least(stop, 3) - line - 1] END, CASE WHEN open AND wa THEN ta ELSE [] END, CASE WHEN open AND wa AND wb THEN tb ELSE [] END, CASE WHEN open AND wa AND wb AND wc AND chap THEN tc ELSE [] END) AS parts FROM jo),
cl AS (SELECT *, list_filter(list_transform(parts, lambda p: regexp_replace(regexp_replace(p, '\\s+', ' ', 'g'), '^ | $', '', 'g')), lambda p: p <> '') AS t FROM pa)
SELECT pdf_page, block, line, CASE WHEN chap THEN 0 ELSE 1 END AS level, CASE WHEN len(t) = 0 THEN '' ELSE list_reduce(t, lambda a, p: CASE WHEN regexp_matches(a, '[-–—]$') THEN a || p ELSE a || ' ' || p END) END AS title FROM cl""")
def picked_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.titles(_spans(spark, sf_dir), STYLES)
