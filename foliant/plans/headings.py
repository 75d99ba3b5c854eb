"""Queries of headings, concepts and lookups: heading levels, phrase patterns, kinds, joins of sections and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import verify as V
from foliant.plans.base import literal, query, values
from foliant.plans.indexing import ALL, PAGES, PLACED, STARTS, SWEEP, TOKENS, _ledger
from foliant.session import table
from foliant.sources import corpus

HEADINGS = [
    (1, "CHAPTER 2", 24.0, "Sans-Bold"), (2, "§ 2.04 Hearsay", 14.0, "Sans-Bold"), (3, "§ 2.04.1 Exceptions", 12.0, "Sans-Bold"), (4, "§ 2.04.1.3 Present sense", 11.0, "Sans-Italic"), (5, "§ 2.05 Not bold", 14.0, "Serif"),
    (6, "plain text", 10.98, "Serif"), (7, "§ 3.01 — Witness", 14.04, "Sans-Bold"), (8, "CHAPTER X", 24.0, "Sans-Bold"),
]
_HEAD = r"^§ (\d+\.\d{2})"
_LEVEL = """CASE WHEN abs(size - 11.0) <= 0.05 AND font = 'Sans-Italic' AND regexp_matches(text, '^§ \\d+[.]\\d{2}[.]\\d+[.]\\d+') THEN 3 WHEN abs(size - 12.0) <= 0.05 AND font = 'Sans-Bold' AND regexp_matches(text, '^§ \\d+[.]\\d{2}[.]\\d+') THEN 2 WHEN abs(size - 14.0) <= 0.05 AND font = 'Sans-Bold' AND regexp_matches(text, '^§ \\d+[.]\\d{2}') THEN 1 WHEN abs(size - 24.0) <= 0.05 AND font = 'Sans-Bold' AND regexp_matches(text, '^CHAPTER \\d+') THEN 0 END"""


@query("prj05_heading_levels", f"SELECT block, {_LEVEL} AS level, CASE WHEN {_LEVEL} > 0 THEN regexp_extract(text, '^§ ([0-9.]+)', 1) WHEN {_LEVEL} = 0 THEN regexp_extract(text, '^CHAPTER ([0-9]+)', 1) END AS ref, CASE WHEN {_LEVEL} > 0 THEN trim(regexp_replace(text, '^§ [0-9.]+(?: —)?', '')) END AS title FROM {values(HEADINGS, 'block, text, size, font')}")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font, size within 0.05 and number decide; the deepest level is tried first. Titles follow on the line."""
    rows = literal(spark, HEADINGS, "block int, text string, size double, font string")

    def is_level(size: float, font: str, pattern: str):
        return (F.abs(F.col("size") - size) <= 0.05) & (F.col("font") == font) & F.col("text").rlike(pattern)

    level = F.when(is_level(11.0, "Sans-Italic", r"^§ \d+\.\d{2}\.\d+\.\d+"), 3).when(is_level(12.0, "Sans-Bold", r"^§ \d+\.\d{2}\.\d+"), 2).when(is_level(14.0, "Sans-Bold", r"^§ \d+\.\d{2}"), 1).when(is_level(24.0, "Sans-Bold", r"^CHAPTER \d+"), 0)
    rows = rows.withColumn("level", level)
    ref = F.when(F.col("level") > 0, F.regexp_extract("text", "^§ ([0-9.]+)", 1)).when(F.col("level") == 0, F.regexp_extract("text", "^CHAPTER ([0-9]+)", 1))
    return rows.select("block", "level", ref.alias("ref"), F.when(F.col("level") > 0, F.trim(F.regexp_replace("text", "^§ [0-9.]+(?: —)?", ""))).alias("title"))


_KINDS = [("noun", "", "topic"), ("doctrine", "RULE", "rule"), ("doctrine", "DOCTRINE", "doctrine"), ("ner", "PERSON", "person"), ("ner", "ORG", "organisation"), ("ner", "LAW", "statute")]
_LABELS = [(1, "noun", ""), (2, "ner", "ORG"), (3, "ner", "GPE"), (4, "doctrine", "RULE")]


@query("prj09_kinds", f"SELECT m.id, coalesce(k.kind, 'topic') AS kind FROM {values(_LABELS, 'id, pass, label')} m LEFT JOIN {values(_KINDS, 'pass, label, kind')} k ON k.pass = m.pass AND k.label = m.label")
def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = F.broadcast(literal(spark, _KINDS, "pass string, label string, kind string"))
    return literal(spark, _LABELS, "id int, pass string, label string").join(lookup, ["pass", "label"], "left").select("id", F.coalesce("kind", F.lit("topic")).alias("kind"))


#: Marks that an extractor takes for citations, next to ones that are some.
MARKS = [("§",), ("§§ ",), ("§2",), ("§12.04",), ("§12.04.",), ("§3.14.5",), ("§12.041",), ("§ 2",), ("§12.04.123",), ("410 U.S.",), ("id.",)]


@query("flt12_citation_noise", f"WITH m AS (SELECT * FROM {values(MARKS, 'mark')} UNION ALL SELECT unnest(regexp_extract_all(text, '§[^ ]*')) FROM documents) SELECT mark, count(*) AS n FROM m WHERE length(mark) <= 8 AND regexp_matches(trim(mark), '^(§+|§[0-9]+([.][0-9][0-9]([.][0-9]+)?)?[.]?)$') GROUP BY 1")
def citation_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown citations of at most eight characters that are bare section signs or references inside the book."""
    marks = literal(spark, MARKS, "mark string").union(table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("§[^ ]*"), 0))))
    noise = (F.length("mark") <= 8) & F.trim("mark").rlike(r"^(§+|§\d+(\.\d{2}(\.\d+)?)?\.?)$")
    return marks.where(noise).groupBy("mark").agg(F.count("*").alias("n"))


@query("flt18_enabled_sources", f"SELECT doc_id FROM documents WHERE source IN (SELECT code FROM {values([('src1', 1), ('src2', 0), ('src3', 1)], 'code, enabled')} WHERE enabled = 1)")
def enabled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = literal(spark, [("src1", 1), ("src2", 0), ("src3", 1)], "code string, enabled int").where("enabled = 1").select(F.col("code").alias("source"))
    return table(spark, sf_dir, "documents").join(F.broadcast(gate), "source", "left_semi").select("doc_id")


@query("jn02_section_parents", f"WITH {PAGES}, {STARTS} SELECT section_ref, level, CASE level WHEN 0 THEN NULL WHEN 1 THEN CAST(chapter AS VARCHAR) ELSE regexp_extract(section_ref, '^[0-9]+[.][0-9]+') END AS parent_ref FROM st")
def section_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section with its parent, which must exist: a missing parent would show as null above level 0."""
    starts = corpus.section_starts(corpus.pages(spark, sf_dir))
    wanted = F.when(F.col("level") == 1, F.col("chapter").cast("string")).when(F.col("level") == 2, F.substring_index("section_ref", ".", 2))
    own = starts.withColumn("wanted", wanted)
    refs = starts.select(F.col("section_ref").alias("wanted"), F.col("level").alias("up"), F.col("section_ref").alias("parent_ref"))
    return own.join(refs.select("wanted", "parent_ref", (F.col("up") + 1).alias("level")), ["wanted", "level"], "left").select("section_ref", "level", "parent_ref")


@query("jn07_chapter_bounds", f"WITH {PAGES}, {STARTS}, b AS (SELECT chapter, min(section_ref) AS first_ref, max(section_ref) AS last_ref FROM st WHERE level = 2 GROUP BY 1) SELECT b.chapter, b.first_ref, p.last_ref AS before_ref, n.first_ref AS after_ref FROM b LEFT JOIN b p ON p.chapter = b.chapter - 1 LEFT JOIN b n ON n.chapter = b.chapter + 1")
def chapter_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = corpus.section_starts(corpus.pages(spark, sf_dir)).where("level = 2")
    b = starts.groupBy("chapter").agg(F.min("section_ref").alias("first_ref"), F.max("section_ref").alias("last_ref"))
    before = b.select((F.col("chapter") + 1).alias("chapter"), F.col("last_ref").alias("before_ref"))
    after = b.select((F.col("chapter") - 1).alias("chapter"), F.col("first_ref").alias("after_ref"))
    return b.join(before, "chapter", "left").join(after, "chapter", "left").select("chapter", "first_ref", "before_ref", "after_ref")


@query("jn09_ledger_bounds", f"{ALL}, l1 AS (SELECT section_ref, level, start_page FROM st) SELECT section_ref, start_page, count(*) AS n FROM ev JOIN l1 USING (section_ref) WHERE verbatim_snippet IS NOT NULL AND level > 0 GROUP BY 1, 2")
def ledger_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = corpus.section_starts(corpus.pages(spark, sf_dir)).where("level > 0").select("section_ref", "start_page")
    return _ledger(spark, sf_dir).groupBy("section_ref").agg(F.count("*").alias("n")).join(starts, "section_ref").select("section_ref", "start_page", "n")


@query("jn14_locator_evidence", f"{ALL}, {SWEEP}, id AS (SELECT section_ref, folio, row_number() OVER (ORDER BY canonical_term, section_ref, folio) AS evidence_id FROM sw) SELECT section_ref, folio, max(evidence_id) AS evidence_id FROM id GROUP BY 1, 2")
def locator_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each locator the last evidence row that has it."""
    from foliant.plans.indexing import evidence_ids

    return evidence_ids(spark, sf_dir).groupBy("section_ref", "folio").agg(F.max("evidence_id").alias("evidence_id"))


@query("jn25_first_token", f"WITH {TOKENS}, h AS (SELECT DISTINCT lower(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')[1]) AS norm FROM benchmark), b AS (SELECT lower(text) AS norm, pdf_page, token_index FROM tk) SELECT norm, min(pdf_page) AS pdf_page, arg_min(token_index, pdf_page * 1000000 + token_index) AS token_index FROM b JOIN h USING (norm) GROUP BY 1")
def first_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "benchmark").select(F.lower(F.get(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0), F.lit(0))).alias("norm")).distinct()
    first = F.min(F.struct("pdf_page", "token_index"))
    return corpus.tokens(spark, sf_dir).join(heads, "norm").groupBy("norm").agg(first.alias("x")).select("norm", "x.pdf_page", "x.token_index")


@query("agg20_run_summary", "SELECT lang AS pass, source AS chunk, count(*) AS n, count(*) FILTER (n_chars < 50) AS failures FROM documents GROUP BY 1, 2")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("pass"), F.col("source").alias("chunk")).agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 50).alias("failures"))


@query("win11_token_index", f"WITH {TOKENS} SELECT pdf_page, max(token_index) + 1 AS n, max(n_body) AS n_body FROM tk GROUP BY 1")
def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.tokens(spark, sf_dir).groupBy("pdf_page").agg((F.max("token_index") + 1).alias("n"), F.count_if(F.col("block_type") == "body").alias("n_body"))


@query("win15_quotes", "SELECT doc_id, substr(text, greatest(strpos(text, ' the ') - 97, 1), 200) AS quote FROM documents WHERE contains(text, ' the ')")
def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.locate(" the ", F.col("text"))
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit(" the "))).select("doc_id", F.substr("text", F.greatest(at - 97, F.lit(1)), F.lit(200)).alias("quote"))


@query("srt10_merged_stream", "WITH m AS (SELECT lower(lang) AS k, 0 AS kind, doc_id AS ordinal FROM documents UNION ALL SELECT lower(source), 1, doc_id FROM documents) SELECT k, kind, ordinal, row_number() OVER (PARTITION BY k, kind ORDER BY ordinal) AS place FROM m")
def merged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.lower("lang").alias("k"), F.lit(0).alias("kind"), F.col("doc_id").alias("ordinal")).union(docs.select(F.lower("source"), F.lit(1), "doc_id"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("k", "kind").orderBy("ordinal")))


_HYPHENS = [(1, "evi-", "dence"), (2, "cross-", "examination"), (3, "well-", "Known"), (4, "A-", "1"), (5, "plain", "text")]


@query("str12_line_end_hyphens", f"SELECT id, regexp_matches(a, '[A-Za-z]-$') AS hyphen, regexp_matches(a, '[A-Za-z]-$') AND regexp_matches(b, '^[a-z]') AND left(a, length(a) - 1) || b IN ('evidence') AS joins FROM {values(_HYPHENS, 'id, a, b')}")
def hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.broadcast(literal(spark, [("evidence",)], "word string"))
    rows = literal(spark, _HYPHENS, "id int, a string, b string").withColumn("hyphen", F.col("a").rlike("[A-Za-z]-$")).withColumn("word", F.concat(F.regexp_replace("a", "-$", ""), F.col("b")))
    return rows.join(known.withColumn("known", F.lit(True)), "word", "left").select("id", "hyphen", (F.col("hyphen") & F.col("b").rlike("^[a-z]") & F.coalesce("known", F.lit(False))).alias("joins"))


@query("str17_locator_text", f"{ALL}, {SWEEP} SELECT canonical_term, '§' || chr(160) || section_ref || ' (p.' || chr(160) || folio || ')' AS label FROM sw")
def locator_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.operators.editorial import locator_text

    return V.sweep(_ledger(spark, sf_dir)).select("canonical_term", locator_text(F.col("section_ref"), F.col("folio")).alias("label"))


_PATTERNS = [("EVIDENCE", "the of"), ("MOTION", "and the"), ("RULE", "in the")]


@query("nlp04_phrase_patterns", f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM w WHERE len(w) > 1) SELECT label, phrase, doc_id, count(*) AS n FROM g JOIN {values(_PATTERNS, 'label, phrase')} p USING (phrase) GROUP BY ALL")
def phrase_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated patterns are phrases with a label, so they are verified like terms."""
    patterns = literal(spark, _PATTERNS, "label string, term string")
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pdf_page"), F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0).alias("norms"))
    found = V.hits(pages, patterns.select("term")).where("mode = 'exact'")
    return found.join(F.broadcast(patterns), "term").groupBy("label", F.col("term").alias("phrase"), F.col("pdf_page").alias("doc_id")).agg(F.count("*").alias("n"))


@query("ed09_whitespace", "SELECT doc_id, replace(replace(text, '  ', ' '), ' ,', ',') AS text FROM documents")
def whitespace_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.col("text")
    for a, b in (("  ", " "), (" ,", ",")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("text"))


_NAMES = [("federal rule", "frcp"), ("cross-examination", None)]


@query("str07_lemma_form", f"SELECT name, regexp_replace(lower(regexp_replace(trim(name), '^(?i:the|an|a)\\s+(\\S)', '\\1')), '([a-z])-([a-z])', '\\1 \\2', 'g') AS form FROM {values([('The Cross-Examination',), ('a well-known rule',), ('An',), ('re-direct',)], 'name')}")
def lemma_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal(spark, [("The Cross-Examination",), ("a well-known rule",), ("An",), ("re-direct",)], "name string")
    return rows.select("name", F.regexp_replace(F.lower(T.strip_article(F.trim("name"))), "(?<=[a-z])-(?=[a-z])", " ").alias("form"))
