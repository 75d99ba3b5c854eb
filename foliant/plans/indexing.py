"""Queries of the corpus, of verification and of index assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import index as I
from foliant.operators import verify as V
from foliant.plans.base import literal, query, values
from foliant.plans.scalars import _sql_lemma
from foliant.session import once, table
from foliant.sources import corpus

PAGES = """pages0 AS (SELECT coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) + 1 AS chapter, doc_id AS pdf_page, n_chars, text FROM documents),
pg AS (SELECT *, row_number() OVER w AS ordinal, CASE WHEN n_chars >= 50 THEN CAST(sum(CASE WHEN n_chars >= 50 THEN 1 ELSE 0 END) OVER w AS VARCHAR) END AS folio, CASE WHEN n_chars >= 50 THEN 'arabic' END AS folio_style FROM pages0 WINDOW w AS (PARTITION BY chapter ORDER BY pdf_page))"""
STARTS = """st AS (SELECT chapter, 0 AS level, CAST(chapter AS VARCHAR) AS section_ref, pdf_page AS start_page FROM pg WHERE ordinal = 1
UNION ALL SELECT chapter, 1, chapter || '.' || printf('%02d', (ordinal - 1) // 10 + 1), pdf_page FROM pg WHERE (ordinal - 1) % 10 = 0
UNION ALL SELECT chapter, 2, chapter || '.' || printf('%02d', (ordinal - 1) // 10 + 1) || '.' || CAST(((ordinal - 1) % 10) // 5 + 1 AS VARCHAR), pdf_page FROM pg WHERE (ordinal - 1) % 5 = 0)"""
PLACED = """pl AS (SELECT p.chapter, p.pdf_page, p.folio, arg_max(s.section_ref, s.level * 1000000000 + s.start_page) AS section_ref, max(s.level) AS level FROM pg p JOIN st s ON s.chapter = p.chapter AND s.start_page <= p.pdf_page GROUP BY ALL)"""
TOKENS = """tk0 AS (SELECT doc_id AS pdf_page, text, CASE WHEN contains(text, chr(10)) AND length(string_split(text, chr(10))[-1]) < 40 THEN length(text) - length(string_split(text, chr(10))[-1]) ELSE length(text) END AS cut FROM documents),
tk1 AS (SELECT pdf_page, regexp_extract_all(left(text, cut), '[\\p{L}\\p{N}]+') AS b, regexp_extract_all(substr(text, cut + 1), '[\\p{L}\\p{N}]+') AS f FROM tk0),
tk AS (SELECT pdf_page, unnest(list_concat(b, f)) AS text, generate_subscripts(list_concat(b, f), 1) - 1 AS token_index, len(b) AS n_body FROM tk1)"""


@query("src05_pages", f"WITH {PAGES} SELECT chapter, pdf_page, ordinal, folio, folio_style, n_chars FROM pg")
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pages(spark, sf_dir)


@query(
    "win01_section_intervals",
    f"WITH {PAGES}, {STARTS} SELECT st.chapter, level, section_ref, 'ch' || st.chapter || ':' || section_ref AS global_id, start_page, coalesce(lead(start_page) OVER (PARTITION BY st.chapter, level ORDER BY start_page), last_page) AS end_page FROM st JOIN (SELECT chapter, max(pdf_page) AS last_page FROM pg GROUP BY 1) l ON l.chapter = st.chapter",
)
def section_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sections(corpus.pages(spark, sf_dir)).drop("section_path")


@query("jn01_deepest_section", f"WITH {PAGES}, {STARTS}, {PLACED} SELECT pdf_page, section_ref, level FROM pl")
def deepest_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.page_sections(corpus.pages(spark, sf_dir)).drop("section_path")


@query("nlp01_tokens", f"WITH {TOKENS} SELECT pdf_page, token_index, text, lower(text) AS norm, {_sql_lemma('lower(text)')} AS lemma, CASE WHEN token_index < n_body THEN 'body' ELSE 'footnote' END AS block_type FROM tk")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.tokens(spark, sf_dir)


#: Terms of one word have so many letters at least.
LONG_WORD = 10


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of three words of the benchmark items, their long words, and a term that occurs nowhere."""
    ws = table(spark, sf_dir, "benchmark").select(V.tokenize(F.col("text")).alias("w"))
    runs = F.when(F.size("w") > 2, F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, F.lit(3)), " "))).otherwise(F.array().cast("array<string>"))
    cut = ws.select(F.explode(F.concat(runs, F.filter("w", lambda x: F.length(x) >= LONG_WORD))).alias("term"))
    return cut.union(spark.range(1).select(F.lit("quux zyzzyva"))).distinct()


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, variant, ordinal): a term of three words without the middle one, and without the first."""
    ws = _terms(spark, sf_dir).select("term", F.split("term", " ").alias("w")).where(F.size("w") == 3)
    forms = F.array(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(2))), F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(2))))
    return ws.select("term", F.posexplode(forms).alias("ordinal", "variant"))


TERMS = r"""tm0 AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
tm AS (SELECT DISTINCT term, string_split(term, ' ') AS words FROM (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS term FROM tm0 UNION ALL SELECT unnest(list_filter(w, lambda x: length(x) >= 10)) FROM tm0 UNION ALL SELECT 'quux zyzzyva'))"""
HITS = f"""bt AS (SELECT pdf_page, token_index AS pos, lower(text) AS norm, {_sql_lemma('lower(text)')} AS lemma FROM tk WHERE token_index < n_body),
nx AS (SELECT *, lead(norm, 1) OVER w AS n2, lead(norm, 2) OVER w AS n3, lead(lemma, 1) OVER w AS l2, lead(lemma, 2) OVER w AS l3 FROM bt WINDOW w AS (PARTITION BY pdf_page ORDER BY pos)),
tl AS (SELECT term, words, list_transform(words, lambda x: {_sql_lemma('x')}) AS ls FROM tm),
ht AS (SELECT term, pdf_page, pos AS start, pos + len(words) - 1 AS stop, CASE WHEN nx.norm = words[1] AND (len(words) < 2 OR n2 = words[2]) AND (len(words) < 3 OR n3 = words[3]) THEN 'exact' ELSE 'lemma' END AS mode FROM nx JOIN tl ON nx.lemma = ls[1] AND (len(words) < 2 OR l2 = ls[2]) AND (len(words) < 3 OR l3 = ls[3]))"""
EVIDENCE = """ar AS (SELECT pdf_page, list_concat(b, f) AS a FROM tk1),
ev0 AS (SELECT h.*, p.section_ref, p.level, coalesce(p.folio, '') AS folio, array_to_string(a[start + 1:stop + 1], ' ') AS matched, array_to_string(a[greatest(start - 30, 0) + 1:start + 31], ' ') AS near, array_to_string(a[greatest(start - 50, 0) + 1:start + 51], ' ') AS far FROM ht h JOIN pl p ON p.pdf_page = h.pdf_page AND p.level > 0 JOIN ar ON ar.pdf_page = h.pdf_page),
ev AS (SELECT term AS canonical_term, matched AS matched_variant, section_ref, level AS section_level, folio, pdf_page, start AS token_offset, mode AS match_mode, CASE WHEN length(near) >= 60 THEN near WHEN length(far) >= 60 THEN far END AS verbatim_snippet FROM ev0)"""
#: Hits of variants count where the term itself has none at the same start.
VARIANT_HITS = """vr AS (SELECT term, words[1] AS a, words[3] AS b, 1 AS rank FROM tm WHERE len(words) = 3 UNION ALL SELECT term, words[2], words[3], 2 FROM tm WHERE len(words) = 3),
vh AS (SELECT DISTINCT term, pdf_page, pos AS start, pos + 1 AS stop, 'variant' AS mode FROM nx JOIN vr ON nx.norm = vr.a AND n2 = vr.b),
hv AS (SELECT * FROM ht UNION ALL SELECT vh.* FROM vh ANTI JOIN ht ON ht.term = vh.term AND ht.pdf_page = vh.pdf_page AND ht.start = vh.start)"""
ALL = f"WITH {PAGES}, {STARTS}, {PLACED}, {TOKENS}, {TERMS}, {HITS}, {EVIDENCE}"


@query("ver02_matches", f"WITH {TOKENS}, {TERMS}, {HITS} SELECT term, pdf_page, start, stop, mode FROM ht")
def ver_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hits(corpus.page_tokens(spark, sf_dir), _terms(spark, sf_dir))


def _ledger(spark: SparkSession, sf_dir: str, with_variants: bool = False) -> DataFrame:
    page = corpus.pages(spark, sf_dir)
    variants = _variants(spark, sf_dir) if with_variants else None
    return V.evidence(V.hits(corpus.page_tokens(spark, sf_dir), _terms(spark, sf_dir), variants, texts=True), corpus.page_sections(page), page)


@query("ver06_ledger", f"{ALL} SELECT * FROM ev WHERE verbatim_snippet IS NOT NULL")
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence of all terms."""
    return _ledger(spark, sf_dir).drop("section_path")


SWEEP = "sw AS (SELECT * FROM ev WHERE verbatim_snippet IS NOT NULL QUALIFY row_number() OVER (PARTITION BY canonical_term, section_ref, folio ORDER BY pdf_page, token_offset) = 1)"


@query("ver07_sweep", f"WITH {PAGES}, {STARTS}, {PLACED}, {TOKENS}, {TERMS}, {HITS}, {VARIANT_HITS}, {EVIDENCE.replace('FROM ht h', 'FROM hv h')}, {SWEEP} SELECT canonical_term, section_ref, folio, pdf_page, token_offset, match_mode FROM sw")
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with their variants, one row for each section and folio."""
    return V.sweep(_ledger(spark, sf_dir, with_variants=True)).select("canonical_term", "section_ref", "folio", "pdf_page", "token_offset", "match_mode")


@query("agg23_hit_counts", f"WITH {TOKENS}, {TERMS}, {HITS}, {VARIANT_HITS} SELECT term, mode, count(*) AS n, count(DISTINCT pdf_page) AS pages FROM hv GROUP BY 1, 2")
def hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned phrases by term and mode."""
    found = V.hits(corpus.page_tokens(spark, sf_dir), _terms(spark, sf_dir), _variants(spark, sf_dir))
    return found.groupBy("term", "mode").agg(F.count("*").alias("n"), F.countDistinct("pdf_page").alias("pages"))


@query(
    "agg10_chapter_citations",
    f"""{ALL}, {SWEEP}, pt AS (SELECT *, CASE WHEN section_level = 1 THEN [section_ref] ELSE [regexp_extract(section_ref, '^[0-9]+[.][0-9]+'), section_ref] END AS path, split_part(section_ref, '.', 1) AS chapter FROM sw),
gr AS (SELECT canonical_term, chapter, min(path) AS lo, max(path) AS hi, arg_min(folio, pdf_page * 1000000 + token_offset) AS folio, min(pdf_page) AS pdf_page, count(*) AS n_hits FROM pt GROUP BY ALL)
SELECT canonical_term, chapter, CASE WHEN lo = hi THEN lo[-1] WHEN lo[1] = hi[1] THEN lo[1] ELSE chapter END AS section_ref, folio, pdf_page, n_hits FROM gr""",
)
def chapter_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by chapter with their lowest common section (AGG-11)."""
    return I.chapter_citations(V.sweep(_ledger(spark, sf_dir)))


@query("agg12_evidence_ids", f"{ALL}, {SWEEP} SELECT canonical_term, section_ref, folio, row_number() OVER (ORDER BY canonical_term, section_ref, folio) AS evidence_id FROM sw")
def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(V.sweep(_ledger(spark, sf_dir)).select("canonical_term", "section_ref", "folio"))
    return I.evidence_ids(rows, "canonical_term")


@query(
    "win09_folio_ranges",
    f"""{ALL}, {SWEEP}, fl AS (SELECT DISTINCT canonical_term, section_ref, folio, try_cast(folio AS INT) AS n FROM sw),
rn AS (SELECT *, n - row_number() OVER (PARTITION BY canonical_term, section_ref ORDER BY n NULLS LAST, folio) AS run FROM fl)
SELECT canonical_term, section_ref, coalesce(min(n), -1) AS first_folio, CASE WHEN min(n) IS NULL OR min(n) = max(n) THEN 'p.' || chr(160) || min(folio) ELSE 'pp.' || chr(160) || min(n) || '–' || max(n) END AS label FROM rn GROUP BY canonical_term, section_ref, coalesce(CAST(run AS VARCHAR), folio)""",
)
def folio_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.folio_ranges(V.sweep(_ledger(spark, sf_dir)).select("canonical_term", "section_ref", "folio").distinct(), ["canonical_term"])


@query(
    "win10_section_ranges",
    f"""{ALL}, {SWEEP}, rf AS (SELECT DISTINCT canonical_term, section_ref, len(string_split(section_ref, '.')) AS depth, CAST(string_split(section_ref, '.')[-1] AS INT) AS n FROM sw),
rp AS (SELECT *, array_to_string(string_split(section_ref, '.')[1:-2], '.') AS prefix FROM rf),
rn AS (SELECT *, n - row_number() OVER (PARTITION BY canonical_term, depth, prefix ORDER BY n) AS run FROM rp)
SELECT canonical_term, depth, arg_min(section_ref, n) AS lo, arg_max(section_ref, n) AS hi, CASE WHEN min(n) = max(n) THEN '§' || arg_min(section_ref, n) ELSE '§§' || arg_min(section_ref, n) || '–' || arg_max(section_ref, n) END AS label FROM rn GROUP BY canonical_term, depth, prefix, run""",
)
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.section_ranges(V.sweep(_ledger(spark, sf_dir)).select("canonical_term", "section_ref"), ["canonical_term"])


SHARED = "sr AS (SELECT DISTINCT canonical_term AS e, section_ref AS r FROM sw), sh AS (SELECT a.e AS a, b.e AS b, count(*) AS shared FROM sr a JOIN sr b ON a.r = b.r AND a.e < b.e GROUP BY ALL HAVING count(*) >= 3)"


@query("jn16_shared_sections", f"{ALL}, {SWEEP}, {SHARED} SELECT * FROM sh")
def shared_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.shared_sections(V.sweep(_ledger(spark, sf_dir)).select(F.col("canonical_term").alias("entry"), "section_ref"))


@query("srt05_see_also", f"{ALL}, {SWEEP}, {SHARED}, bo AS (SELECT a AS entry, b AS target, shared FROM sh UNION ALL SELECT b, a, shared FROM sh) SELECT * FROM bo QUALIFY row_number() OVER (PARTITION BY entry ORDER BY shared DESC, target) <= 5")
def see_also(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.see_also(V.sweep(_ledger(spark, sf_dir)).select(F.col("canonical_term").alias("entry"), "section_ref"))


SURF = r"""sf0 AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS surface, doc_id FROM documents),
sf AS (SELECT surface, min(doc_id) AS first_seen FROM sf0 GROUP BY 1)"""


@query(
    "agg09_canonical",
    f"WITH {SURF}, bk AS (SELECT {_sql_lemma('lower(surface)')} AS bucket, surface, first_seen FROM sf) SELECT bucket, surface AS canonical FROM bk QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY regexp_matches(surface, '^[A-Z]{{2,6}}$'), length(surface) DESC, first_seen, surface) = 1",
)
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemma buckets of all surfaces (AGG-08) and the surface that each elects."""
    from foliant.functions import text as T

    seen = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0)).alias("surface"))
    surfaces = seen.groupBy("surface").agg(F.min("doc_id").alias("first_seen"))
    return I.elect_canonical(surfaces.withColumn("bucket", T.lemma(F.lower("surface"))))


OPENING = "[A-Z][a-z]+ [a-z]+"
#: Every phrase of a capitalised word and the next, in all texts: candidates for headings.
OPENINGS = f"op AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{OPENING}')) AS canonical FROM documents)"


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(OPENING), 0)).alias("canonical")).distinct()


SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x')"
#: Names whose slugs meet each other and the numbered ones.
CLASHING = [("A b",), ("a-b",), ("a b 2",), ("a  b",), ("!",), ("x",), ("x 2",), ("x-3",), ("?",)]


@query(
    "win13_unique_slugs",
    f"""WITH RECURSIVE {OPENINGS}, e AS (SELECT canonical FROM op UNION SELECT * FROM {values(CLASHING, 'canonical')}), s AS (SELECT canonical, {SLUG.format('canonical')} AS base, regexp_replace({SLUG.format('canonical')}, '(-[0-9]+)+$', '') AS root FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY lower(canonical), canonical) AS i FROM s),
g AS (SELECT root, 0 AS i, []::VARCHAR[] AS taken, NULL::VARCHAR AS canonical, NULL::VARCHAR AS slug FROM (SELECT DISTINCT root FROM o)
UNION ALL SELECT g.root, g.i + 1, list_append(taken, n.slug), o.canonical, n.slug FROM g JOIN o ON o.root = g.root AND o.i = g.i + 1, LATERAL (SELECT CASE WHEN list_contains(taken, base) THEN list_filter(list_transform(range(2, len(taken) + 3), lambda k: base || '-' || k), lambda c: NOT list_contains(taken, c))[1] ELSE base END AS slug) n)
SELECT canonical, slug FROM g WHERE canonical IS NOT NULL""",
)
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.unique_slugs(openings(spark, sf_dir).union(literal(spark, CLASHING, "canonical string")).distinct())


@query(
    "agg16_synthetic_stems",
    f"WITH {OPENINGS}, w AS (SELECT DISTINCT canonical, {_sql_lemma('x')} AS stem FROM (SELECT canonical, unnest(string_split(lower(canonical), ' ')) AS x FROM op)) SELECT stem, count(*) AS n, min(canonical) AS first_member FROM w WHERE regexp_matches(stem, '^[a-z]{{4,}}$') GROUP BY stem HAVING count(*) >= 3",
)
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.synthetic_stems(openings(spark, sf_dir))


#: Two versions of an index: by language, with one length told otherwise.
VERSIONS = "o AS (SELECT doc_id, n_chars FROM documents WHERE lang IN ('en', 'de')), n AS (SELECT doc_id, CASE WHEN lang = 'fr' OR source = 'src1' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE lang IN ('en', 'fr'))"


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    told = F.when((F.col("lang") == "fr") | (F.col("source") == "src1"), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return docs.where(F.col("lang").isin("en", "de")).select("doc_id", "n_chars"), docs.where(F.col("lang").isin("en", "fr")).select("doc_id", told.alias("n_chars"))


@query("jn22_index_diff", f"WITH {VERSIONS} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.n_chars <> n.n_chars")
def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = versions(spark, sf_dir)
    return I.diff(old, new, "doc_id", "n_chars")
