"""Queries of the scalar functions (STR, PRJ, FLT) over literal rows and over texts of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import citations as C
from foliant.functions import text as T
from foliant.plans.base import literal, query, values
from foliant.session import table

TEXTS = [
    (1, "ﬁnal eﬃcient  “quote” — and … end"), (2, "  soft­hyphen zero​width  nbsp here "), (3, "The Hearsay Rule"), (4, "a rule"), (5, "An"), (6, "MOTION TO COMPEL: THE BASICS OF IT"),
    (7, "FRE"), (8, "THE FRCP"), (9, "(opinion"), (10, "opinion (s)"), (11, "a. outline"), (12, "x"), (13, "*starred"), (14, "§ 2.04 hearsay"), (15, "2.04 hearsay"), (16, "interrogatories"),
    (17, "classes of witness"), (18, "Fed. R. Civ. P. 26(b)(1)"), (19, "Federal Rule of Evidence 403"), (20, "Model Rule 3.3"), (21, "Smith v. Jones"), (22, "28 U.S.C. § 1331"), (23, "Fifth Amendment"),
    (24, "in re Smith"), (25, "United States v. Nixon"), (26, "ok , spaced"), (27, "page 12 here"), (28, "Why Be an Advocate"), (29, "Preparing the Direct Examination of"), (30, "Voir Dire of the Jury"), (31, "attorneys' fees"),
    (32, "Über größe"), (33, ""), (34, "Describe the Burden of Proof"),
]
SQL_TEXTS = values(TEXTS, "id, s")
#: Lines of the first documents' texts stand beside the literal rows.
SQL_LINES = f"(SELECT id, s FROM {SQL_TEXTS} UNION ALL SELECT doc_id + 1000, text FROM documents)"


def _texts(spark: SparkSession) -> DataFrame:
    return literal(spark, TEXTS, "id long, s string")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).union(table(spark, sf_dir, "documents").select(F.col("doc_id") + 1000, "text"))


def _sql_normalize(s: str) -> str:
    out = f"translate({s}, '{''.join(T.ONE_TO_ONE).replace(chr(39), chr(39) * 2)}{T.INVISIBLE}', '{''.join(T.ONE_TO_ONE.values()).replace(chr(39), chr(39) * 2)}')"
    for a, b in (T.LIGATURES | T.LONGER).items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"lower(trim(regexp_replace({out}, '\\s+', ' ', 'g')))"


def _sql_lemma(w: str) -> str:
    return f"CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN {w}[:-4] || 'y' WHEN length({w}) > 4 AND regexp_matches({w}, '(ss|x|z|ch|sh)es$') THEN {w}[:-3] WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN {w}[:-2] ELSE {w} END"


def _sql_article(s: str) -> str:
    return f"regexp_replace({s}, '^(?i:the|an|a)\\s+(\\S)', '\\1')"


@query("str01_normalize", f"SELECT id, {_sql_normalize('s')} AS norm FROM {SQL_LINES}")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("id", T.normalize(F.col("s")).alias("norm"))


@query("str02_canonicalize", f"SELECT id, translate(s, '{T.INVISIBLE}', '') AS canonical FROM {SQL_LINES}")
def canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("id", T.canonicalize(F.col("s")).alias("canonical"))


@query("str03_collapse_whitespace", f"SELECT id, trim(regexp_replace(s, '[\\s ]+', ' ', 'g')) AS collapsed FROM {SQL_LINES}")
def collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("id", T.collapse(F.col("s")).alias("collapsed"))


_PROSE = [("(?i)\\bFederal\\s+Rules?\\s+of\\s+Evidence", "FRE"), ("(?i)\\bFederal\\s+Rules?\\s+of\\s+Civil\\s+Procedure", "FRCP"), ("(?i)\\bFederal\\s+Rules?\\s+of\\s+Appellate\\s+Procedure", "FRAP"), ("(?i)\\bModel\\s+Rules?(?:\\s+of\\s+Professional\\s+Conduct)?", "MRPC")]
_NUM = "\\s+(\\d+(?:\\.\\d+)*(?:\\([a-z0-9]+\\))*)"


@query("str04_prose_to_canonical", "SELECT id, CASE " + " ".join(f"WHEN regexp_matches(s, '{p}{_NUM}') THEN '{k} ' || regexp_extract(s, '{p}{_NUM}', 1)" for p, k in _PROSE) + f" ELSE s END AS canonical FROM {SQL_TEXTS}")
def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", C.prose_to_rule(F.col("s")).alias("canonical"))


@query("str05_slugify", f"SELECT id, CASE WHEN slug = '' THEN 'x' ELSE slug END AS slug FROM (SELECT id, trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM {SQL_LINES})")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("id", T.slugify(F.col("s")).alias("slug"))


@query("str06_strip_article", f"SELECT id, {_sql_article('s')} AS bare, lower({_sql_article('s')}) AS sort_key FROM {SQL_TEXTS}")
def article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", T.strip_article(F.col("s")).alias("bare"), T.sort_key(F.col("s")).alias("sort_key"))


@query("str08_lemma", f"SELECT w AS word, n, {_sql_lemma('w')} AS lemma FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM documents) GROUP BY w)")
def lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0)).alias("word"))
    return ws.groupBy("word").agg(F.count("*").alias("n")).select("word", "n", T.lemma(F.col("word")).alias("lemma"))


@query("str09_title_case")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", T.title_case(F.col("s")).alias("title"))


@query(
    "str10_plural",
    "SELECT w AS word, CASE WHEN regexp_matches(w, '[^aeiou]y$') THEN regexp_replace(w, 'y$', 'ies') WHEN regexp_matches(w, '(s|x|z|ch|sh)$') THEN w || 'es' ELSE w || 's' END AS plural FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark)",
)
def plural(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0)).alias("word")).distinct()
    return ws.select("word", T.plural(F.col("word")).alias("plural"))


@query("str11_head_and_first_word", f"SELECT id, string_split_regex(trim(s), '\\s+')[-1] AS head, string_split_regex(trim(s), '\\s+')[1] AS first FROM {SQL_TEXTS}")
def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", T.head_noun(F.col("s")).alias("head"), T.first_word(F.col("s")).alias("first"))


@query("str14_recapitalize", f"SELECT id, replace(replace(s, 'rule', 'Rule'), 'hearsay', 'Hearsay') AS recapped FROM {SQL_TEXTS}")
def recap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.col("s")
    for a, b in (("rule", "Rule"), ("hearsay", "Hearsay")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return _texts(spark).select("id", out.alias("recapped"))


@query("str20_heading_phrases")
def heading_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", F.explode(T.heading_phrases(F.col("s"))).alias("phrase"))


_COUNTS = [(0, 0, 0), (1, 0, 5), (0, 3, 0), (4, 4, 1), (2, 2, 2)]


@query(
    "str21_suggested_fix",
    "SELECT a, b, c, CASE WHEN a = 0 AND b = 0 AND c = 0 THEN 'noise/none' WHEN c > a AND c > 0 THEN 'bigram_inflected/variant_loss_patch' WHEN a = 0 AND b > 0 THEN 'lemma_collision/lemma_override' ELSE 'unknown/none' END AS fix FROM " + values(_COUNTS, "a, b, c"),
)
def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, _COUNTS, "a int, b int, c int").select("a", "b", "c", T.suggested_fix(F.col("a"), F.col("b"), F.col("c")).alias("fix"))


_FOLIOS = [(1, "iv"), (2, "12"), (3, "A-3"), (4, None), (5, "XIX"), (60, None), (7, "mcmxcix"), (8, "A7"), (9, "1a")]
_REGION = "CASE style WHEN 'roman' THEN 'front_matter' WHEN 'arabic' THEN 'body' WHEN 'prefix' THEN 'back_matter' ELSE CASE WHEN page < 40 THEN 'front_matter' ELSE 'body' END END"


@query("prj01_page_region", f"SELECT page, folio, style, {_REGION} AS region FROM (SELECT *, CASE WHEN regexp_matches(folio, '^[0-9]+$') THEN 'arabic' WHEN regexp_matches(folio, '^(?i:[ivxlcdm]+)$') THEN 'roman' WHEN regexp_matches(folio, '^[A-Z]-?[0-9]+$') THEN 'prefix' END AS style FROM {values(_FOLIOS, 'page, folio')})")
def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = literal(spark, _FOLIOS, "page int, folio string").withColumn("style", T.folio_style(F.col("folio")))
    return out.select("page", "folio", "style", T.page_region(F.col("style"), F.col("page")).alias("region"))


@query("prj04_folio_value")
def folio_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, _FOLIOS, "page int, folio string").select("page", "folio", T.folio_int(F.col("folio")).alias("value"))


@query("prj08_locator_prefix", f"SELECT id, regexp_matches(s, '^\\s*(§|\\d{{1,2}}\\.\\d{{2}})') AS rejected FROM {SQL_LINES}")
def locator_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("id", T.has_locator_prefix(F.col("s")).alias("rejected"))


_TABLES = [(p.regex, "rules") for p in C.RULES] + [(C.STATUTES[0].regex, "statutes"), (C.STATUTES[1].regex, "statutes"), (r"\b\d+\s+U\.?\s*S\.?\s*C\.?\s", "statutes"), (r"^[A-Za-z][A-Za-z.''-]+\s+v\.\s+[A-Za-z]", "cases")]


@query("prj10_table_of_citation", "SELECT id, CASE " + " ".join(f"WHEN regexp_matches(s, '{r}') THEN '{t}'" for r, t in _TABLES) + f" END AS tbl FROM {SQL_TEXTS}")
def table_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", C.table_of(F.col("s")).alias("tbl"))


@query("flt03_artifacts", f"SELECT id, length(s) < 3 OR regexp_matches(s, '(^|\\s)\\d+(\\s|$)') OR regexp_matches(s, '\\s[.,;:!?)\\]]|[(\\[]\\s') AS artifact FROM {SQL_LINES}")
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("id", T.is_artifact(F.col("s")).alias("artifact"))


_CRUFT = T.CRUFT_FIRST.replace("'", "''")


@query(
    "flt05_cruft",
    f"SELECT id, length(s) < 2 OR length(s) > 100 OR contains('{_CRUFT}', left(s, 1)) OR regexp_matches(s, '^[a-z]\\.\\s+') OR length(s) - length(replace(s, '(', '')) <> length(s) - length(replace(s, ')', '')) AS cruft FROM {SQL_LINES}",
)
def cruft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("id", T.is_cruft(F.col("s")).alias("cruft"))


@query("flt07_acronym", f"SELECT id, regexp_matches({_sql_article('s')}, '^[A-Z]{{2,6}}$') AS acronym FROM {SQL_LINES}")
def acronym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("id", T.is_acronym(F.col("s")).alias("acronym"))


@query("flt08_substantive_head", f"SELECT id, head, length(head) >= 4 AND lower(head) NOT IN ({', '.join(repr(h) for h in T.STOP_HEADS)}) AS substantive FROM (SELECT id, string_split_regex(trim(s), '\\s+')[-1] AS head FROM {SQL_TEXTS})")
def substantive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", T.head_noun(F.col("s")).alias("head")).select("id", "head", T.is_substantive(F.col("head")).alias("substantive"))


@query("flt13_count_status", "SELECT n, CASE WHEN n < 800 THEN 'under' WHEN n > 1500 THEN 'over' ELSE 'ok' END AS status FROM (SELECT count(*) AS n FROM documents)")
def count_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return n.select("n", F.when(F.col("n") < 800, "under").when(F.col("n") > 1500, "over").otherwise("ok").alias("status"))


@query(
    "srt03_case_sort_key",
    "SELECT id, CASE "
    + " ".join(f"WHEN lower(s) LIKE '{p.lower()}%' THEN ltrim(substr(s, {len(p) + 1}))" for p in T.PARTY_PREFIXES)
    + f" ELSE s END AS sort_key FROM {SQL_TEXTS}",
)
def case_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark).select("id", T.case_sort_key(F.col("s")).alias("sort_key"))


CITED = [
    (1, 1, "Under FRE 403(b)(1) and FRCP 26 the court cited Fed. R. Civ. P. 12(b)(6). Then Rule 56(c) applied."),
    (2, 1, "The Fifth Amendment and the Twenty-first Amendment; U.S. Const. art. III, § 2 governs. See 28 U.S.C. § 1331."),
    (3, 2, "Federal Rules of Evidence 801(d) and federal rule of civil procedure 30(b)(6). Model Rule 3.4(c)(1) too. FRE 404"),
    (4, 2, "Smith v. Jones, 410 U.S. 113 (1973), the court held. Later Rule 11 was raised far away from any other thing in the text."),
    (5, 3, "no citation here"), (6, 3, "fre 403 is low case; FRE403 is not spaced"), (7, 3, "FRE 403, then Rule 404(a) at once and again FRE 403."),
]


def _sql_count(p: C.Pattern) -> str:
    r = p.regex.replace("'", "''")
    return f"SELECT id, '{p.kind}' AS kind, unnest(regexp_extract_all(s, '{r}', 0)) AS surface FROM {values([(i, t) for i, _, t in CITED], 'id, s')}"


@query("cit01_05_citations", "SELECT id, kind, surface, count(*) AS n FROM (" + " UNION ALL ".join(_sql_count(p) for p in C.RULES + C.STATUTES + (C.CASE,)) + ") GROUP BY ALL")
def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = literal(spark, CITED, "id int, chapter int, s string").select("id", F.explode(C.citations(F.col("s"))).alias("c"))
    return hits.groupBy("id", F.col("c.kind").alias("kind"), F.col("c.surface").alias("surface")).agg(F.count("*").alias("n"))


@query("cit01_05_citation_offsets")
def citation_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, CITED, "id int, chapter int, s string").select("id", F.explode(C.citations(F.col("s"))).alias("c")).select("id", "c.*")


_SYSTEMS = [(1, "FRE"), (2, "FRCP")]


@query("cit06_bare_rules")
def bare_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare rules take the system of their chapter; one just behind an explicit citation of the page is its echo (JN-11)."""
    pages = literal(spark, CITED, "id int, chapter int, s string")
    explicit = pages.select("id", F.explode(C.citations(F.col("s"), C.RULES)).alias("c")).select("id", F.col("c.start").alias("start"))
    bare = pages.select("id", "chapter", F.explode(C.matches(F.col("s"), C.BARE)).alias("c")).select("id", "chapter", "c.number", "c.path", "c.start")
    gap = F.col("b.start") - F.col("e.start")
    alone = bare.alias("b").join(explicit.alias("e"), (F.col("b.id") == F.col("e.id")) & gap.between(0, C.BARE_REACH), "left_anti")
    systems = F.broadcast(literal(spark, _SYSTEMS, "chapter int, system string"))
    return alone.join(systems, "chapter", "left").select("id", "number", "path", "start", F.coalesce("system", F.lit("Rule")).alias("system"))
