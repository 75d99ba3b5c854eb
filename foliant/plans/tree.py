"""Queries of the index tree: editorial rules, entries with their locators, rendered lines and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import citations as C
from foliant.functions import text as T
from foliant.operators import editorial as E
from foliant.operators import graph as G
from foliant.operators import index as I
from foliant.operators import render as R
from foliant.operators import tables as B
from foliant.operators import verify as V
from foliant.plans.base import literal, query, values
from foliant.plans.indexing import ALL, HITS, OPENING, OPENINGS, PAGES, PLACED, SHARED, SLUG, STARTS, SWEEP, TERMS, TOKENS, _ledger, _terms, openings
from foliant.plans.scalars import CITED, _sql_lemma
from foliant.session import once, table
from foliant.sources import corpus

# Entries of all texts: an opening in lower case, its spellings, and each source and document that has it

EN = f"""c0 AS (SELECT unnest(regexp_extract_all(text, '{OPENING}')) AS c, source, doc_id FROM documents),
en AS (SELECT lower(c) AS canonical, string_agg(DISTINCT c, '|' ORDER BY c) AS v FROM c0 GROUP BY 1),
lo AS (SELECT DISTINCT lower(c) AS canonical, source AS section_ref, doc_id AS folio FROM c0)"""

#: A fixture of rules, some of which fit nothing.
RULES = [
    ("R1", "from ou", None), ("R1", "no such entry", None), ("R2", "TO THE", "To the"), ("R2", "ABSENT WORD", "Absent word"), ("R3", "and the", "and then"), ("R3", "and then", "and so"), ("R3", "absent phrase", "nothing"), ("R3", "of old", "the to"),
    ("R4", "the of", None), ("R4", "gone phrase", None), ("R5", "stone", None), ("R6", "that", None), ("R7", "the the", "the and"), ("R7", "absent artifact", "absent target"), ("R7", "absent artifact", "the and"), ("R8", "of the", "of thes"), ("R8", "absent singular", "absent plural"), ("R9", "  ", " "),
]


def entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(id, canonical, variants) and (id, section_ref, folio)."""
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(OPENING), 0)).alias("c"), "source", "doc_id").distinct()
    named = found.withColumn("canonical", F.lower("c"))
    own = named.groupBy("canonical").agg(F.array_sort(F.collect_set("c")).alias("variants")).select(F.col("canonical").alias("id"), "canonical", "variants")
    return own, named.select(F.col("canonical").alias("id"), F.col("source").alias("section_ref"), F.col("doc_id").alias("folio")).distinct()


def _rules(spark: SparkSession, *kinds: str) -> DataFrame:
    return literal(spark, [r for r in RULES if not kinds or r[0] in kinds], "rule string, term string, target string")


def _applied(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    own, places = entries(spark, sf_dir)
    kept, placed, _ = E.apply_rules(own, places, _rules(spark, *kinds), allow_stale=True)
    counts = placed.groupBy("id").agg(F.count("*").alias("n"))
    return kept.join(counts, "id", "left").select("id", "canonical", F.array_join("variants", "|").alias("v"), F.coalesce("n", F.lit(0)).alias("n"))


def _ruled(canonical: str, v: str = "v", moved: bool = False, where: str = "true") -> str:
    """Entries after one class of rules, in SQL."""
    home = "CASE WHEN canonical = 'the the' AND EXISTS (SELECT 1 FROM en WHERE canonical = 'the and') THEN 'the and' ELSE canonical END" if moved else "canonical"
    return f"WITH {EN}, lc AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT {home} AS id, section_ref, folio FROM lo) GROUP BY 1) SELECT canonical AS id, {canonical} AS canonical, {v} AS v, n FROM en JOIN lc ON lc.id = en.canonical WHERE {where}"


GONE = "canonical <> 'the of'"
FOLDED = "NOT (canonical = 'the the' AND EXISTS (SELECT 1 FROM en WHERE canonical = 'the and'))"
# A chain of two renamings, of which the second is ambiguous if its name was there before the first; one whose result is there already, and whose name is not, does nothing.
RENAMED = "CASE canonical WHEN 'and the' THEN CASE WHEN EXISTS (SELECT 1 FROM en WHERE canonical = 'and then') THEN 'and then' ELSE 'and so' END WHEN 'and then' THEN CASE WHEN EXISTS (SELECT 1 FROM en WHERE canonical = 'and the') THEN 'and then' ELSE 'and so' END WHEN 'of old' THEN 'the to' ELSE canonical END"
RECASED = "CASE canonical WHEN 'to the' THEN 'To the' WHEN 'absent word' THEN 'Absent word' ELSE canonical END"
CLEARED = "CASE WHEN canonical IN ('from ou', 'no such entry') THEN '' ELSE v END"
PLURALS = "CASE canonical WHEN 'of the' THEN 'of thes' WHEN 'absent singular' THEN 'absent plural' ELSE canonical END"


@query("ed00_apply_rules", f"SELECT id, CASE WHEN c2 = 'of the' THEN 'of thes' WHEN c2 = 'to the' THEN 'To the' ELSE c2 END AS canonical, v, n FROM ({_ruled(RENAMED, CLEARED, True, f'{GONE} AND {FOLDED}')}) t(id, c2, v, n)")
def apply_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries after all rules, with the number of their locators."""
    return _applied(spark, sf_dir)


@query("ed01_strip_variants", _ruled("canonical", CLEARED))
def strip_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, sf_dir, "R1")


@query("ed02_recapitalize", _ruled(RECASED))
def recapitalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, sf_dir, "R2")


@query("ed03_reword", _ruled(RENAMED))
def reword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, sf_dir, "R3")


@query("ed04_delete_entries", _ruled("canonical", where=GONE))
def delete_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, sf_dir, "R4")


@query("ed07_fold_entries", _ruled("canonical", moved=True, where=FOLDED))
def fold_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, sf_dir, "R7")


@query("ed08_plural_canonicals", _ruled(PLURALS))
def plural_canonicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, sf_dir, "R8")


STEMS = f"w AS (SELECT DISTINCT canonical, {_sql_lemma('x')} AS stem FROM (SELECT canonical, unnest(string_split(lower(canonical), ' ')) AS x FROM op)), s AS (SELECT stem FROM w WHERE regexp_matches(stem, '^[a-z]{{4,}}$') GROUP BY 1 HAVING count(*) >= 3)"
HEADS = f"e AS (SELECT DISTINCT lower(canonical) AS c FROM op), h AS (SELECT string_split(c, ' ')[-1] AS head, c FROM e), xr AS (SELECT head, min(c) AS target FROM h WHERE length(head) >= 4 AND head NOT IN ({', '.join(repr(x) for x in T.STOP_HEADS)}) AND head NOT IN (SELECT c FROM e) GROUP BY 1)"


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = openings(spark, sf_dir).select(F.lower("canonical").alias("c")).distinct()
    heads = own.select(T.head_noun(F.col("c")).alias("head"), "c").where(T.is_substantive(F.col("head")))
    return heads.join(own.select(F.col("c").alias("head")), "head", "left_anti").groupBy("head").agg(F.min("c").alias("target"))


@query("ed05_removed_xrefs", f"WITH {OPENINGS}, {HEADS} SELECT head, target FROM xr WHERE head <> 'stone'")
def removed_xrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-references but those whose head a rule removes: known only to the renderer, so the rules pass the heads on."""
    done = E.run_rules({}, [r for r in RULES if r[0] == "R5"])
    return _heads(spark, sf_dir).where(~F.col("head").isin(sorted(done.removed_xrefs)))


@query("ed06_suppressed_stems", f"WITH {OPENINGS}, {STEMS} SELECT stem, count(*) AS n FROM w JOIN s USING (stem) WHERE stem <> 'that' GROUP BY 1")
def suppressed_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = E.run_rules({}, [r for r in RULES if r[0] == "R6"])
    return I.synthetic_stems(openings(spark, sf_dir)).where(~F.col("stem").isin(sorted(done.suppressed_stems))).select("stem", "n")


_NEEDS = [(r, t, x) for r, t, x in RULES if r in ("R1", "R2", "R3", "R4", "R7", "R8") and (r, t) not in (("R3", "and the"), ("R3", "and then")) and (r, t, x) != ("R7", "absent artifact", "the and")]


@query(
    "ed00_mismatches",
    f"""WITH {EN}, r AS (SELECT * FROM {values(_NEEDS, 'rule, term, target')}), k AS (SELECT canonical FROM en WHERE {GONE})
SELECT rule, CASE WHEN rule = 'R7' THEN target ELSE term END AS term, 'no_match' AS reason FROM r WHERE CASE rule WHEN 'R7' THEN target NOT IN (SELECT canonical FROM k) WHEN 'R4' THEN term NOT IN (SELECT canonical FROM en) WHEN 'R2' THEN lower(term) NOT IN (SELECT canonical FROM k) ELSE term NOT IN (SELECT canonical FROM k) AND coalesce(target, '') NOT IN (SELECT canonical FROM k) END
UNION ALL SELECT 'R3', 'and the', 'no_match' WHERE NOT EXISTS (SELECT 1 FROM k WHERE canonical IN ('and the', 'and then'))
UNION ALL SELECT 'R3', 'and then', 'no_match' WHERE NOT EXISTS (SELECT 1 FROM k WHERE canonical IN ('and the', 'and then', 'and so'))
UNION ALL SELECT 'R3', 'and then', 'ambiguous' WHERE EXISTS (SELECT 1 FROM k WHERE canonical = 'and the') AND EXISTS (SELECT 1 FROM k WHERE canonical = 'and then')
UNION ALL SELECT 'R7', 'the and', 'no_match' WHERE NOT EXISTS (SELECT 1 FROM k WHERE canonical = 'the and')""",
)
def mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that fit no entry of their turn, with the reason."""
    done = E.compile_rules(entries(spark, sf_dir)[0], _rules(spark))
    return spark.createDataFrame(done.mismatches, "rule string, term string, reason string")


@query("srt12_suggestions")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule that fits nothing, the three most similar names."""
    own = entries(spark, sf_dir)[0]
    return E.suggestions(spark.createDataFrame(E.compile_rules(own, _rules(spark)).mismatches, "rule string, term string, reason string").select("term"), own)


#: A curator's list of entries to leave out.
REMOVED = [("the and",), ("in in",), ("The and",), ("no such entry",)]


@query("flt06_removed", f"WITH {EN} SELECT canonical FROM en WHERE canonical NOT IN (SELECT term FROM {values(REMOVED, 'term')})")
def removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names on the list go, letter for letter."""
    listed = F.broadcast(literal(spark, REMOVED, "canonical string"))
    return entries(spark, sf_dir)[0].select("canonical").join(listed, "canonical", "left_anti")


@query("flt10_variants", f"WITH {OPENINGS}, b AS (SELECT DISTINCT lower(string_split(canonical, ' ')[2]) AS id, lower(canonical) AS variant FROM op), r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY length(variant) DESC, variant) AS rank, variant FROM b) SELECT * FROM r WHERE rank <= 3")
def shown_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants that are shown of an entry: here of each word the openings that end with it."""
    rows = openings(spark, sf_dir).select(F.lower(F.get(F.split("canonical", " "), F.lit(1))).alias("id"), F.col("canonical").alias("v"))
    # A word by itself is its own variant in other case, so it never shows.
    own = rows.groupBy("id").agg(F.array_sort(F.collect_set("v")).alias("v"), F.collect_set(F.upper("id")).alias("u"))
    shown = E.filter_variants(own.select("id", F.col("id").alias("canonical"), F.concat("u", "v").alias("variants")))
    return shown.select("id", "rank", F.lower("variant").alias("variant"))


@query("srt02_entry_order", f"WITH {OPENINGS}, k AS (SELECT canonical, lower(CASE WHEN regexp_matches(canonical, '^(The|An|A) ') THEN regexp_replace(canonical, '^(The|An|A) +', '') ELSE canonical END) AS sort_key FROM op) SELECT canonical, sort_key, row_number() OVER (PARTITION BY left(sort_key, 1) ORDER BY sort_key, canonical) AS place FROM k")
def entry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = openings(spark, sf_dir).select("canonical", T.sort_key(F.col("canonical")).alias("sort_key"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.left("sort_key", F.lit(1))).orderBy("sort_key", "canonical")))


# Entries of verified terms

RUNS = "fl AS (SELECT DISTINCT {0}, section_ref, folio, try_cast(folio AS INT) AS n FROM {1}), rn AS (SELECT *, n - row_number() OVER (PARTITION BY {0}, section_ref ORDER BY n NULLS LAST, folio) AS run FROM fl), lb AS (SELECT {0}, list_transform(string_split(section_ref, '.'), lambda x: CAST(x AS INT)) AS nums, min(n) AS lo, '§' || chr(160) || section_ref || ' (' || CASE WHEN min(n) = max(n) THEN 'p.' || chr(160) || min(n) ELSE 'pp.' || chr(160) || min(n) || '–' || max(n) END || ')' AS label FROM rn GROUP BY {0}, section_ref, run), ll AS (SELECT {0}, string_agg(label, ', ' ORDER BY nums, lo) AS w FROM lb GROUP BY {0})"
LISTS = RUNS.format("canonical_term", "sw")
ARTICLE = "lower(CASE WHEN regexp_matches({0}, '^(the|an|a) .') THEN regexp_replace({0}, '^(the|an|a) +', '') ELSE {0} END)"
#: Java has two letters for the capital of one.
LETTER = "CASE WHEN left({0}, 1) = 'ß' THEN 'SS' ELSE upper(left({0}, 1)) END"


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sweep(_ledger(spark, sf_dir))


@query("rnd07_locator_lists", f'{ALL}, {SWEEP}, {LISTS} SELECT canonical_term, w AS "where" FROM ll')
def locator_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.locator_lists(swept(spark, sf_dir), "canonical_term")


@query("rnd02_entry_lines", f"{ALL}, {SWEEP}, {LISTS} SELECT {ARTICLE.format('canonical_term')} AS key, canonical_term AS head, canonical_term || ', ' || w AS line FROM ll")
def entry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(R.locator_lists(swept(spark, sf_dir), "canonical_term")).select(F.col("canonical_term").alias("id"), F.col("canonical_term").alias("canonical"), "where")
    return R.entry_lines(rows.select("id", "canonical"), rows.select("id", "where")).select("key", "head", "line")


TERM_STEMS = f"tw AS (SELECT DISTINCT canonical_term, {_sql_lemma('x')} AS stem FROM (SELECT canonical_term, unnest(string_split(canonical_term, ' ')) AS x FROM ll)), ts AS (SELECT stem FROM tw WHERE regexp_matches(stem, '^[a-z]{{4,}}$') GROUP BY 1 HAVING count(*) >= 3), sb AS (SELECT stem, canonical_term FROM tw JOIN ts USING (stem) WHERE stem NOT IN (SELECT canonical_term FROM ll))"


def _siblings(lists: DataFrame) -> DataFrame:
    named = lists.select(F.col("canonical_term").alias("canonical"))
    stems = I.synthetic_stems(named).select("stem").join(named.select(F.lower("canonical").alias("stem")), "stem", "left_anti")
    return I.stem_members(named).join(stems, "stem").select("stem", "canonical")


@query("rnd03_synthetic_blocks", f"{ALL}, {SWEEP}, {LISTS}, {TERM_STEMS} SELECT stem AS head, 0 AS place, stem AS line FROM (SELECT DISTINCT stem FROM sb) UNION ALL SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY canonical_term), '    ' || canonical_term || ', ' || w FROM sb JOIN ll USING (canonical_term)")
def synthetic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = once(R.locator_lists(swept(spark, sf_dir), "canonical_term"))
    return R.synthetic_lines(_siblings(lists), lists.select(F.col("canonical_term").alias("canonical"), "where")).select("head", "place", "line")


@query("rnd04_xref_lines", f"WITH {OPENINGS}, {HEADS} SELECT head, head || '. See ' || target || '.' AS line FROM xr")
def xref_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.xref_lines(_heads(spark, sf_dir)).select("head", "line")


@query("rnd05_consolidated_lines", f"WITH {EN}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM benchmark), p AS (SELECT a.w AS singular, b.w AS plural FROM w a JOIN w b ON b.w = CASE WHEN regexp_matches(a.w, '[^aeiou]y$') THEN regexp_replace(a.w, 'y$', 'ies') WHEN regexp_matches(a.w, '(s|x|z|ch|sh)$') THEN a.w || 'es' ELSE a.w || 's' END) SELECT singular, plural, singular || CASE WHEN plural LIKE '%ies' THEN '(ies)' ELSE '(' || substr(plural, length(singular) + 1) || ')' END || '. See ' || left(singular, 4) || '.' AS line FROM p")
def consolidated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word and its plural as one cross-reference: here to their first letters."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("w")).distinct()
    pairs = w.select(F.col("w").alias("singular"), T.plural(F.col("w")).alias("plural")).join(w.select(F.col("w").alias("plural")), "plural")
    return R.consolidated_lines(pairs.select("singular", "plural", F.left("singular", F.lit(4)).alias("target"), F.lit(None).cast("string").alias("where")))


TERM_HEADS = f"th AS (SELECT string_split(canonical_term, ' ')[-1] AS head, canonical_term FROM ll WHERE contains(canonical_term, ' ')), tx AS (SELECT head, min(canonical_term) AS target FROM th WHERE length(head) >= 4 AND head NOT IN ({', '.join(repr(x) for x in T.STOP_HEADS)}) AND head NOT IN (SELECT canonical_term FROM ll) AND head NOT IN (SELECT stem FROM sb) GROUP BY 1)"


@query(
    "rnd01_index_lines",
    f"""{ALL}, {SWEEP}, {LISTS}, {TERM_STEMS}, {TERM_HEADS},
m AS (SELECT {ARTICLE.format('canonical_term')} AS key, 0 AS kind, canonical_term AS head, 0 AS place, canonical_term || ', ' || w AS line FROM ll
UNION ALL SELECT DISTINCT stem, 1, stem, 0, stem FROM sb UNION ALL SELECT stem, 1, stem, row_number() OVER (PARTITION BY stem ORDER BY canonical_term), '    ' || canonical_term || ', ' || w FROM sb JOIN ll USING (canonical_term)
UNION ALL SELECT head, 2, head, 0, head || '. See ' || target || '.' FROM tx),
b AS (SELECT {LETTER.format('key')} AS letter, row_number() OVER (PARTITION BY {LETTER.format('key')} ORDER BY key, kind, head, place, line) AS ord, line FROM m)
SELECT * FROM b UNION ALL SELECT DISTINCT letter, 0, '## ' || letter FROM b""",
)
def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject index: entries, synthetic entries and cross-references in one order, with letter dividers."""
    return index_of(swept(spark, sf_dir))


def index_of(rows: DataFrame) -> DataFrame:
    lists = once(R.locator_lists(rows, "canonical_term"))
    named = lists.select(F.col("canonical_term").alias("id"), F.col("canonical_term").alias("canonical"), "where")
    siblings = _siblings(lists)
    heads = named.where(F.contains("canonical", F.lit(" "))).select(T.head_noun(F.col("canonical")).alias("head"), "canonical").where(T.is_substantive(F.col("head")))
    known = named.select(F.col("canonical").alias("head")).union(siblings.select("stem"))
    xrefs = heads.join(known, "head", "left_anti").groupBy("head").agg(F.min("canonical").alias("target"))
    return R.merged([R.entry_lines(named.select("id", "canonical"), named.select("id", "where")), R.synthetic_lines(siblings, named.select("canonical", "where")), R.xref_lines(xrefs)])


# Steps of the tree


@query("asm01_index_tree", f"{ALL}, {SWEEP}, {SHARED}, e AS (SELECT canonical_term AS canonical, count(*) AS n_locators, count(DISTINCT section_ref) AS n_sections FROM sw GROUP BY 1), bo AS (SELECT a AS entry, b AS target, shared FROM sh UNION ALL SELECT b, a, shared FROM sh), sa AS (SELECT entry, count(*) AS n FROM (SELECT entry FROM bo QUALIFY row_number() OVER (PARTITION BY entry ORDER BY shared DESC, target) <= 5) GROUP BY 1) SELECT {SLUG.format('canonical')} AS id, canonical, {ARTICLE.format('canonical')} AS sort_key, n_locators, n_sections, coalesce(sa.n, 0) AS n_see_also FROM e LEFT JOIN sa ON sa.entry = canonical")
def index_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the finished tree: identifier, key, locators and see-also links. Terms without evidence have none (ASM-04)."""
    rows = swept(spark, sf_dir)
    sizes = rows.groupBy(F.col("canonical_term").alias("canonical")).agg(F.count("*").alias("n_locators"), F.countDistinct("section_ref").alias("n_sections"))
    links = I.see_also(rows.select(F.col("canonical_term").alias("entry"), "section_ref")).groupBy(F.col("entry").alias("canonical")).agg(F.count("*").alias("n"))
    out = sizes.join(I.unique_slugs(sizes.select("canonical")), "canonical").join(links, "canonical", "left")
    return out.select(F.col("slug").alias("id"), "canonical", T.sort_key(F.col("canonical")).alias("sort_key"), "n_locators", "n_sections", F.coalesce("n", F.lit(0)).alias("n_see_also"))


@query("asm04_zero_evidence", f"{ALL}, {SWEEP} SELECT term FROM tm WHERE term NOT IN (SELECT canonical_term FROM sw)")
def zero_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are dropped from the index because nothing supports them: the log of the drop."""
    return _terms(spark, sf_dir).join(_ledger(spark, sf_dir).select(F.col("canonical_term").alias("term")).distinct(), "term", "left_anti")


@query("asm06_see_edges", f"WITH {OPENINGS}, e AS (SELECT canonical, {SLUG.format('canonical')} AS id, unnest([string_split(canonical, ' ')[1], string_split(canonical, ' ')[2], upper(canonical)]) AS v FROM op), g AS (SELECT DISTINCT {SLUG.format('v')} AS slug, id FROM e) SELECT slug, id FROM g WHERE slug <> id")
def see_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the slug of each variant to the entries that have it: here the words of an opening and its capitals. A variant with its entry's own slug gives none."""
    words = F.split("canonical", " ")
    rows = openings(spark, sf_dir).select(T.slugify(F.col("canonical")).alias("id"), F.explode(F.array(F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.upper("canonical"))).alias("v"))
    return G.see_edges(rows)


@query("asm07_degrees", f"{ALL}, {SWEEP}, {SHARED}, bo AS (SELECT a AS src, b AS dst FROM sh UNION ALL SELECT b, a FROM sh) SELECT src, count(*) AS degree FROM bo GROUP BY 1 HAVING count(*) > 5")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with more than five links before they are cut to the first five."""
    pairs = I.shared_sections(swept(spark, sf_dir).select(F.col("canonical_term").alias("entry"), "section_ref"))
    return G.crowded(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a")))


@query("jn15_chapter_locators", f"{ALL}, {SWEEP}, c AS (SELECT *, split_part(section_ref, '.', 1) AS chapter FROM sw) SELECT canonical_term, chapter, arg_min(section_ref, pdf_page * 1000000 + token_offset) AS section_ref, arg_min(folio, pdf_page * 1000000 + token_offset) AS folio FROM c GROUP BY 1, 2")
def chapter_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The locator of each term and chapter, told by its first evidence row there."""
    first = F.min(F.struct("pdf_page", "token_offset", "section_ref", "folio")).alias("x")
    rows = swept(spark, sf_dir).groupBy("canonical_term", F.substring_index("section_ref", ".", 1).alias("chapter")).agg(first)
    return rows.select("canonical_term", "chapter", "x.section_ref", "x.folio")


@query("set02_surfaces", f"WITH {TOKENS}, {TERMS}, {HITS}, s AS (SELECT h.term, lower(array_to_string(list_concat(b, f)[start + 1:stop + 1], ' ')) AS form FROM ht h JOIN tk1 ON tk1.pdf_page = h.pdf_page UNION SELECT term, term FROM tm) SELECT term, string_agg(DISTINCT form, '|' ORDER BY form) AS forms FROM s GROUP BY 1")
def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of a term: all that it matched, and itself."""
    terms = _terms(spark, sf_dir)
    found = V.hits(corpus.page_tokens(spark, sf_dir), terms, texts=True).select("term", F.lower("matched").alias("form"))
    return found.union(terms.select("term", "term")).groupBy("term").agg(F.array_join(F.array_sort(F.collect_set("form")), "|").alias("forms"))


@query("ver08_bridges", f"WITH {TOKENS}, {TERMS}, {HITS}, p AS (SELECT term, string_split(term, ' ')[1] AS one FROM tm WHERE len(words) = 3), j AS (SELECT DISTINCT p.term, pdf_page, start FROM p JOIN ht ON ht.term = p.term UNION SELECT p.term, pdf_page, start FROM p JOIN ht ON ht.term = p.one) SELECT term, count(*) AS n, min(pdf_page) AS first_page FROM j GROUP BY 1")
def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations that are verified in two spellings, here a term and its first word where that is a term too: a place counts once."""
    terms = _terms(spark, sf_dir)
    spellings = terms.where(F.size(F.split("term", " ")) == 3).select(F.col("term").alias("name"), F.explode(F.array(F.col("term"), F.substring_index("term", " ", 1))).alias("spelling"))
    known = spellings.join(terms.select(F.col("term").alias("spelling")), "spelling")
    return B.bridged(V.hits(corpus.page_tokens(spark, sf_dir), terms), known).groupBy(F.col("name").alias("term")).agg(F.count("*").alias("n"), F.min("pdf_page").alias("first_page"))


@query("win12_section_text", f"WITH {PAGES}, {STARTS}, {PLACED}, {TOKENS} SELECT section_ref, count(*) AS pages, sha256(string_agg(array_to_string(b, ' '), chr(10) || chr(10) ORDER BY pl.pdf_page)) AS text_sha256 FROM pl JOIN tk1 ON tk1.pdf_page = pl.pdf_page WHERE len(b) > 0 GROUP BY 1")
def section_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body text of each section: tokens by spaces, a blank line where the page changes. A section, not a chapter, is the unit, so no row holds a whole chapter."""
    placed = corpus.page_sections(corpus.pages(spark, sf_dir)).select("pdf_page", "section_ref")
    words = corpus.page_tokens(spark, sf_dir).select("pdf_page", F.array_join(F.slice("texts", F.lit(1), F.size("norms")), " ").alias("text")).where(F.size("norms") > 0)
    pages = words.join(placed, "pdf_page").groupBy("section_ref").agg(F.count("*").alias("pages"), F.array_sort(F.collect_list(F.struct("pdf_page", "text"))).alias("t"))
    return pages.select("section_ref", "pages", F.sha2(F.array_join(F.transform("t", lambda x: x["text"]), "\n\n"), 256).alias("text_sha256"))


@query("win12_gaps", f"WITH {TOKENS}, b AS (SELECT pdf_page, token_index, lag(pdf_page) OVER (ORDER BY pdf_page, token_index) AS p0 FROM tk WHERE token_index < n_body) SELECT count(*) FILTER (pdf_page <> p0) AS page_changes FROM b")
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the page changes in the stream of body tokens: one less than there are pages with any."""
    pages = corpus.page_tokens(spark, sf_dir).where(F.size("norms") > 0)
    return pages.agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("page_changes"))


@query("agg15_section_depths", f"{ALL}, {SWEEP} SELECT len(string_split(section_ref, '.')) AS depth, count(*) AS n FROM sw GROUP BY 1")
def section_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swept(spark, sf_dir).groupBy(F.size(F.split("section_ref", r"\.")).alias("depth")).agg(F.count("*").alias("n"))


@query("srt07_section_table", f"{ALL}, {SWEEP}, c AS (SELECT section_ref, count(*) AS n FROM sw GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, section_ref) AS rank FROM c) SELECT section_ref, n FROM r WHERE rank <= 20 UNION ALL SELECT 'long tail', CAST(coalesce(sum(n), 0) AS BIGINT) FROM r WHERE rank > 20")
def section_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty sections with most locators and the sum of the others: a report, so the limit is its feature."""
    counts = swept(spark, sf_dir).groupBy("section_ref").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "section_ref").limit(20)
    rest = counts.join(top.select("section_ref"), "section_ref", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return top.union(rest.select(F.lit("long tail"), "n"))


# Tables of citations

SMALL_CAPS = [("T ABLE OF C ASES", None), ("I  NDEX 12", "12"), ("A BC D EF", None), ("   ", None), ("12 P ART  Xii", "xii"), ("plain head 7", "7")]


@query("str13_running_heads")
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running heads with their folio taken out and spaced small capitals joined, over literal heads and the first lines of all texts."""
    heads = literal(spark, SMALL_CAPS, "head string, folio string").union(table(spark, sf_dir, "documents").select(F.substring_index("text", "\n", 1), F.lit(None).cast("string")))
    return heads.select("head", "folio", T.running_head(F.col("head"), F.col("folio")).alias("section")).distinct()


CITED_SQL = f"ct AS (SELECT CAST(page AS BIGINT) AS page, chapter, text FROM {values(CITED, 'page, chapter, text')} UNION ALL SELECT doc_id + 1000, 0, text FROM documents)"


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, chapter, text): sentences with citations, and all documents."""
    return literal(spark, CITED, "page int, chapter int, text string").select(F.col("page").cast("long").alias("page"), "chapter", "text").union(table(spark, sf_dir, "documents").select(F.col("doc_id") + 1000, F.lit(0), "text"))


@query("rnd08_table_of_cases", f"WITH {CITED_SQL}, m AS (SELECT page, chapter, unnest(regexp_extract_all(text, '{C.CASE.regex.replace(chr(39), chr(39) * 2)}')) AS s FROM ct), n AS (SELECT page, chapter, regexp_extract(s, '{C.CASE.regex.replace(chr(39), chr(39) * 2)}', 1) AS name, regexp_extract(s, '{C.CASE.regex.replace(chr(39), chr(39) * 2)}', 2) AS cite FROM m) SELECT '*' || name || '*, ' || arg_min(cite, (chapter, page)) || ', p. ' || string_agg(DISTINCT page, ', ' ORDER BY page) AS line FROM n GROUP BY name")
def table_of_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases in italics with their first citation and all pages."""
    found = B.hits(cited(spark, sf_dir))
    cases = B.cases_table(found)
    pages = found.where("kind = 'CASE'").select(F.col("number").alias("name"), "page").distinct().groupBy("name").agg(F.concat(F.lit("p. "), F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda x: x.cast("string")), ", ")).alias("where"))
    rows = cases.join(pages, "name").select("sort_key", F.col("name").alias("head"), "cite", "where", F.array().cast("array<struct<label:string,where:string>>").alias("below"))
    return R.table_lines(rows, italic=True).select("line")


@query("rnd10_table_of_rules")
def table_of_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with their subsections below them."""
    found = B.hits(cited(spark, sf_dir)).where(F.col("kind").isin([p.kind for p in C.RULES]))
    pages = lambda *by: found.select(*by, "page").distinct().groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda x: x.cast("string")), ", ").alias("where"))
    name = F.concat("system", F.lit(" "), "number")
    parents = pages("system", "number").select("system", "number", F.concat("system", F.lit(" "), F.lpad("number", 4, "0")).alias("sort_key"), name.alias("head"), "where")
    parts = pages("system", "number", "path").where("path <> ''").groupBy("system", "number").agg(F.collect_list(F.struct(F.concat(name, F.col("path")).alias("label"), "where")).alias("below"))
    rows = parents.join(parts, ["system", "number"], "left").select("sort_key", "head", F.lit(None).cast("string").alias("cite"), "where", F.coalesce("below", F.array().cast("array<struct<label:string,where:string>>")).alias("below"))
    return R.table_lines(rows)


_STATUTE = r"\d+\s+U[.]?\s*S[.]?\s*C[.]?\s+§+\s*\d+[a-z]*"


@query("rnd09_table_of_statutes", f"WITH {CITED_SQL}, m AS (SELECT page, unnest(regexp_extract_all(text, '\\b{_STATUTE}')) AS s FROM ct), n AS (SELECT page, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS name FROM m) SELECT name || ', ' || string_agg(DISTINCT page, ', ' ORDER BY page) AS line FROM n GROUP BY name")
def table_of_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes, those that differ by white space merged first."""
    found = B.hits(cited(spark, sf_dir)).where("kind = 'USC'").select(F.col("page").alias("ordinal"), F.col("surface").alias("canonical"), "page")
    name = F.trim(F.regexp_replace("canonical", r"\s+", " "))
    pages = found.select(name.alias("head"), "page").distinct().groupBy("head").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda x: x.cast("string")), ", ").alias("where"))
    rows = pages.select(F.lower("head").alias("sort_key"), "head", F.lit(None).cast("string").alias("cite"), "where", F.array().cast("array<struct<label:string,where:string>>").alias("below"))
    return R.table_lines(rows).select("line")


DERIVED = [("b1", "Strickland v. Washington"), ("b1", "Strickland prejudice"), ("b2", "Miranda v. Arizona"), ("b2", "warnings"), ("b3", "In re Gault v. State"), ("b3", "the gault standard"), ("b4", "plain concept")]


@query("flt04_derived_concepts", f"WITH s AS (SELECT * FROM {values(DERIVED, 'bucket, surface')}), f AS (SELECT bucket, lower(string_split(trim(split_part(surface, ' v.', 1)), ' ')[-1]) AS party FROM s WHERE regexp_matches(surface, '[A-Za-z.''-]+\\s+v\\.\\s+[A-Za-z]')) SELECT DISTINCT f.bucket FROM f JOIN s ON s.bucket = f.bucket WHERE NOT regexp_matches(s.surface, '[A-Za-z.''-]+\\s+v\\.\\s+[A-Za-z]') AND contains(s.surface, ' ') AND list_contains(string_split(lower(s.surface), ' '), party)")
def derived_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets where a surface names a case and another, of several words, has its first party among them."""
    return B.derived(literal(spark, DERIVED, "bucket string, surface string"))
