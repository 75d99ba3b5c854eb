"""Queries of editorial rules, citation tables, the cross-reference graph, set operations and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import graph as G
from foliant.operators import tables as B
from foliant.operators import verify as V
from foliant.plans.base import literal, query, values
from foliant.plans.indexing import ALL, SWEEP, TOKENS, _ledger
from foliant.plans.scalars import CITED, _sql_lemma
from foliant.session import table
from foliant.sources import corpus

def _hits(spark: SparkSession) -> DataFrame:
    return B.hits(literal(spark, CITED, "page int, chapter int, text string"))


@query("agg18_rules_table")
def rules_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rules_table(_hits(spark))


@query("agg18_cases_table", f"SELECT * FROM {values([('Smith v. Jones', '410 U.S. 113', 4, 0, 1, 'smith v. jones')], 'name, cite, first_page, first_start, n, sort_key')}")
def cases_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.cases_table(_hits(spark))


@query("agg19_counters")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.counters(_hits(spark))


@query("jn10_subsections")
def subsections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _hits(spark)
    evidence = found.where(F.col("kind").isin("FRE", "FRCP")).select("page", "system", "number").distinct()
    return B.attach_subsections(evidence, found)


_STATUTES = [(1, "28 U.S.C. § 1331", 4), (2, "28  U.S.C.  § 1331", 9), (3, "42 U.S.C. § 1983", 2), (4, "28 U.S.C. § 1331 ", 4)]


@query("agg17_spaced_statutes", f"SELECT trim(regexp_replace(canonical, '\\s+', ' ', 'g')) AS canonical, min(ordinal) AS ordinal, string_agg(DISTINCT page, ',' ORDER BY page) AS pages FROM (SELECT ordinal, canonical, CAST(page AS VARCHAR) AS page FROM {values(_STATUTES, 'ordinal, canonical, page')}) GROUP BY 1")
def spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.merge_spaced(literal(spark, _STATUTES, "ordinal int, canonical string, page int"))


@query("cit09_short_forms", "WITH c AS (SELECT CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS chapter, doc_id AS place, doc_id % 4 = 0 AS is_full, 'c' || doc_id AS name FROM documents), l AS (SELECT *, last_value(CASE WHEN is_full THEN name END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antecedent FROM c) SELECT chapter, place, name, antecedent FROM l WHERE NOT is_full")
def short_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return B.short_forms(docs.select(F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("chapter"), F.col("doc_id").alias("place"), (F.col("doc_id") % 4 == 0).alias("is_full"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("name")))


@query("asm05_subdivide")
def subdivide(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read many times below, so it is kept in the checkpoint folder.
    swept = G.settled(V.sweep(_ledger(spark, sf_dir)).select("canonical_term", "section_ref", "folio"))
    single = F.size(F.split("canonical_term", " ")) == 1
    return G.subdivide(swept.where(single).withColumnRenamed("canonical_term", "parent"), swept.where(~single).withColumnRenamed("canonical_term", "sub"))


#: Each document points to that of half its number, and those of one source also to that of twice theirs.
EDGES = "ed AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents WHERE doc_id > 0 UNION ALL SELECT doc_id, doc_id * 2 FROM documents WHERE source = 'src3' AND doc_id > 0)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id > 0").select(F.col("doc_id").alias("src"), "source")
    return docs.select("src", F.floor(F.col("src") / 2).alias("dst")).union(docs.where("source = 'src3'").select("src", F.col("src") * 2))


@query("asm07_cycles", f"WITH RECURSIVE {EDGES}, re AS (SELECT DISTINCT src, dst FROM ed UNION SELECT re.src, ed.dst FROM re JOIN ed ON ed.src = re.dst) SELECT DISTINCT ed.src, ed.dst FROM ed JOIN re ON re.src = ed.dst AND re.dst = ed.src")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges on cycles: an edge is on one if its end reaches its start."""
    return G.on_cycles(_edges(spark, sf_dir))


@query("jn24_dangling", f"WITH {EDGES} SELECT src, dst FROM ed WHERE dst NOT IN (SELECT doc_id FROM documents)")
def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dangling(_edges(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


@query("jn06_section_path", "WITH RECURSIVE s AS (SELECT doc_id AS section_id, CASE WHEN doc_id < 10 THEN NULL ELSE doc_id // 10 END AS parent_id FROM documents), up AS (SELECT section_id, section_id AS node, 0 AS depth FROM s UNION ALL SELECT u.section_id, s.parent_id, u.depth + 1 FROM up u JOIN s ON s.section_id = u.node WHERE s.parent_id IS NOT NULL) SELECT section_id, arg_max(node, depth) AS root, max(depth) AS depth FROM up GROUP BY 1")
def section_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return G.section_path(spark, docs.select(F.col("doc_id").alias("section_id"), F.when(F.col("doc_id") >= 10, F.floor(F.col("doc_id") / 10)).alias("parent_id")))


@query("jn23_orphan_variants", f"{ALL} SELECT DISTINCT term FROM tm WHERE term NOT IN (SELECT lower(matched_variant) FROM ev WHERE verbatim_snippet IS NOT NULL)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.plans.indexing import _terms

    return _terms(spark, sf_dir).join(_ledger(spark, sf_dir).select(F.lower("matched_variant").alias("term")).distinct(), "term", "left_anti")


@query("agg13_term_counts", f"""WITH {TOKENS}, b AS (SELECT lower(text) AS norm, {_sql_lemma('lower(text)')} AS lemma FROM tk WHERE token_index < n_body), h AS (SELECT DISTINCT lower(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')[1]) AS term FROM benchmark),
l AS (SELECT norm, count(*) AS n FROM b GROUP BY 1), m AS (SELECT lemma, count(*) AS n FROM b GROUP BY 1)
SELECT term, coalesce(l.n, 0) AS literal, coalesce(m.n, 0) AS by_lemma FROM h LEFT JOIN l ON l.norm = term LEFT JOIN m ON m.lemma = term""")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "benchmark").select(F.lower(F.get(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0), F.lit(0))).alias("term")).distinct()
    body = corpus.tokens(spark, sf_dir).where("block_type = 'body'")
    # Both counts are combined in the map tasks, so only distinct words are shuffled.
    literal_n = body.groupBy(F.col("norm").alias("term")).agg(F.count("*").alias("literal"))
    lemma_n = body.groupBy(F.col("lemma").alias("term")).agg(F.count("*").alias("by_lemma"))
    return heads.join(literal_n, "term", "left").join(lemma_n, "term", "left").select("term", F.coalesce("literal", F.lit(0)).alias("literal"), F.coalesce("by_lemma", F.lit(0)).alias("by_lemma"))


@query("set01_union_passes", "SELECT k, string_agg(p, ',' ORDER BY p) AS passes FROM (SELECT DISTINCT lang AS k, 'a' AS p FROM documents UNION SELECT DISTINCT source, 'b' FROM documents UNION SELECT DISTINCT lang, 'c' FROM documents WHERE n_chars > 1000) GROUP BY k")
def union_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    passes = docs.select(F.col("lang").alias("k"), F.lit("a").alias("p")).unionByName(docs.select(F.col("source").alias("k"), F.lit("b").alias("p"))).unionByName(docs.where("n_chars > 1000").select(F.col("lang").alias("k"), F.lit("c").alias("p")))
    return passes.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("passes"))


@query("agg05_noun_phrases", f"""WITH w AS (SELECT coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) + 1 AS chapter, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
g AS (SELECT chapter, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM w WHERE len(w) > 1),
k AS (SELECT *, split_part(phrase, ' ', 1) AS a, split_part(phrase, ' ', 2) AS b FROM g)
SELECT chapter, {_sql_lemma('a')} || ' ' || {_sql_lemma('b')} AS key, count(*) AS n, min(phrase) AS term, least(count(DISTINCT phrase) - 1, 10) AS variants, min(doc_id) AS first_page FROM k GROUP BY 1, 2 HAVING count(*) >= 2""")
def noun_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word phrases of a chapter by their lemmas that occur twice or more (a stand-in for noun chunks): the alphabetically first form, and up to ten others."""
    docs = table(spark, sf_dir, "documents")
    chapter = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0)) + 1
    ws = docs.select(chapter.alias("chapter"), "doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0).alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = ws.select("chapter", "doc_id", F.explode(pairs).alias("p")).select("chapter", "doc_id", F.concat_ws(" ", "p.a", "p.b").alias("phrase"), F.concat_ws(" ", T.lemma(F.col("p.a")), T.lemma(F.col("p.b"))).alias("key"))
    # By form first, in the map tasks, so that counting forms needs no second pass over the tokens.
    forms = rows.groupBy("chapter", "key", "phrase").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_page"))
    return forms.groupBy("chapter", "key").agg(F.sum("n").alias("n"), F.min("phrase").alias("term"), F.least(F.count("*") - 1, F.lit(10)).alias("variants"), F.min("first_page").alias("first_page")).where("n >= 2")


@query("win03_forward_fill", "SELECT doc_id, last_value(CASE WHEN n_chars % 5 = 0 THEN lang END IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id) AS marker FROM documents")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "documents").select("doc_id", F.last(F.when(F.col("n_chars") % 5 == 0, F.col("lang")), ignorenulls=True).over(by).alias("marker"))


@query("jn13_title_filter", "WITH t AS (SELECT DISTINCT lower(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1))) AS title FROM pages), c AS (SELECT DISTINCT lower(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1))) AS phrase, page_id % 2 AS odd FROM pages UNION SELECT DISTINCT lang, 0 FROM documents) SELECT phrase, odd FROM c WHERE phrase NOT IN (SELECT title FROM t) OR odd = 1")
def title_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are section titles go, unless curated."""
    pages = table(spark, sf_dir, "pages")
    title = F.lower(F.trim(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1)))
    titles = pages.select(title.alias("phrase")).distinct()
    candidates = pages.select(title.alias("phrase"), (F.col("page_id") % 2).alias("odd")).union(table(spark, sf_dir, "documents").select("lang", F.lit(0).cast("long"))).distinct()
    return candidates.join(titles.withColumn("known", F.lit(True)), "phrase", "left").where("known IS NULL OR odd = 1").select("phrase", "odd")


@query("agg22_corpus_hash", "WITH h AS (SELECT sha256('=' || doc_id || '|' || coalesce('=' || text, '~')) AS h FROM documents), b AS (SELECT left(h, 4) || ':' || count(*) || ':' || sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)::HUGEINT) || ':' || sum(CAST('0x' || substr(h, 17, 15) AS BIGINT)::HUGEINT) || ':' || sum(CAST('0x' || substr(h, 33, 15) AS BIGINT)::HUGEINT) || ':' || sum(CAST('0x' || substr(h, 49, 15) AS BIGINT)::HUGEINT) AS s FROM h GROUP BY left(h, 4)) SELECT sha256(string_agg(s, '|' ORDER BY s)) AS corpus_sha256 FROM b")
def corpus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.sources.sinks import content_hash

    return content_hash(table(spark, sf_dir, "documents").select("doc_id", "text"))
