"""The index tree: editorial rules, slugs, graphs, sections and lines against small models in plain Python."""

import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import editorial as E
from foliant.operators import graph as G
from foliant.operators import index as I
from foliant.operators import layout as L
from foliant.operators import render as R
from foliant.operators import tables as B
from foliant.operators import verify as V
from foliant.sources import corpus, sinks


def test_rules_apply_one_after_the_other():
    rules = [("R3", "a", "b"), ("R3", "b", "c"), ("R4", "gone", None), ("R7", "x x", "x"), ("R8", "rule", "rules"), ("R2", "FRE", "FRE"), ("R1", "c", None), ("R3", "twin", "twins"), ("R3", "absent", "nothing"), ("R4", "never", None), ("R5", "head", None), ("R6", "stem", None), ("R9", "  ", " ")]
    done = E.run_rules({"a": 1, "gone": 2, "x": 1, "x x": 1, "rules": 1, "fre": 1, "twin": 2}, rules)
    fate = {g.first: (g.now, g.cleared, g.into) for g in done.groups}
    assert fate == {"a": ("c", True, None), "gone": (None, False, None), "x": ("x", False, None), "x x": (None, False, "x"), "rules": ("rules", False, None), "fre": ("FRE", False, None), "twin": ("twin", False, None)}
    assert done.mismatches == [("R4", "never", "no_match"), ("R3", "twin", "ambiguous"), ("R3", "absent", "no_match")]
    assert (done.removed_xrefs, done.suppressed_stems, done.replacements) == ({"head"}, {"stem"}, [("  ", " ")])
    assert [r[0] for r in done.report] == sorted((r[0] for r in rules), key=E.ORDER.index)
    again = E.run_rules({"c": 1, "x": 1, "rules": 1, "FRE": 1}, [r for r in rules if r[0] in ("R7", "R8", "R2")])
    assert again.mismatches == [] and all(g.now == g.first for g in again.groups)


def test_rules_on_rows(spark):
    entries = spark.createDataFrame([("1", "x", ["v"]), ("2", "x x", ["w"]), ("3", "a", None), ("4", None, [])], "id string, canonical string, variants array<string>")
    places = spark.createDataFrame([("1", "1.01", "3"), ("2", "1.01", "3"), ("2", "1.02", "4"), ("3", "2.01", "5")], "id string, section_ref string, folio string")
    rules = lambda rows: spark.createDataFrame(rows, "rule string, term string, target string")
    kept, placed, _ = E.apply_rules(entries, places, rules([("R7", "x x", "x"), ("R1", "x", None), ("R3", "a", "b")]))
    assert {tuple(r) for r in kept.select("id", "canonical", F.coalesce(F.size("variants"), F.lit(-1))).collect()} == {("1", "x", 0), ("3", "b", -1), ("4", None, 0)}
    assert {tuple(r) for r in placed.collect()} == {("1", "1.01", "3"), ("1", "1.02", "4"), ("3", "2.01", "5")}
    with pytest.raises(ValueError, match="do not fit"):
        E.apply_rules(entries, places, rules([("R4", "nowhere", None)]))
    assert E.apply_rules(entries.limit(0), places.limit(0), rules([("R4", "nowhere", None)]), allow_stale=True)[0].count() == 0


def test_suggestions_are_those_of_difflib(spark):
    names = ["hearsay rule", "hearsay rules", "rule of hearsay", "motion", "motions", "emotion", "zzz", "hearsay"]
    got = E.suggestions(spark.createDataFrame([("hearsay rul",), ("motoin",), ("qqqq",)], "term string"), spark.createDataFrame([(n,) for n in names], "canonical string").repartition(3)).collect()
    for term in ("hearsay rul", "motoin", "qqqq"):
        assert [r["canonical"] for r in sorted(got, key=lambda r: r["rank"]) if r["term"] == term] == difflib.get_close_matches(term, names, 3, 0.6)


def test_slugs_skip_what_is_taken(spark):
    names = ["a b", "a-b", "A  b", "a b 2", "a b 2 2", "x", "!", "?", "x-2", "other"]
    got = {r["canonical"]: r["slug"] for r in I.unique_slugs(spark.createDataFrame([(n,) for n in names], "canonical string")).collect()}
    taken = {}
    for n in sorted(names, key=lambda n: (n.lower(), n)):
        base = "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in n.lower()).split()) or "x"
        slug = next(s for s in itertools.chain([base], (f"{base}-{i}" for i in itertools.count(2))) if s not in taken.values())
        taken[n] = slug
    assert got == taken


def test_edges_on_cycles(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(38)] + [(i, i + 1) for i in range(100, 170)] + [(200, 201), (201, 200), (201, 202), (202, 203), (203, 202), (300, 300), (1, None)]
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for x in ahead.get(todo.pop(), ()):
                if x is not None and x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    want = {(a, b) for a, b in edges if b is not None and a in reach(b) | {b}}
    assert {tuple(r) for r in G.on_cycles(spark.createDataFrame(edges, "src long, dst long")).collect()} == want and (201, 202) not in want
    assert G.on_cycles(spark.createDataFrame([(1, 2)], "src long, dst long")).count() == 0


def test_long_chapters_have_distinct_sections(spark, tmp_path):
    rows = [(i * 7, "text " * 20, "en", "src0", 100) for i in range(1200)] + [(i * 7 + 1, "t", "en", "src1", 1) for i in range(13)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    page = corpus.pages(spark, str(tmp_path))
    starts = corpus.section_starts(page)
    refs = [r["section_ref"] for r in starts.where("level = 1 AND chapter = 1").collect()]
    assert len(refs) == len(set(refs)) == 120 and "1.01" in refs and "1.120" in refs
    placed = {r["pdf_page"]: r["section_ref"] for r in corpus.page_sections(page).collect()}
    assert all(placed[i * 7] == f"1.{i // 10 + 1:02d}.{i % 10 // 5 + 1}" for i in range(1200))
    folios = {r["pdf_page"]: (r["ordinal"], r["folio"]) for r in page.collect()}
    assert all(folios[i * 7] == (i + 1, str(i + 1)) for i in range(1200)) and folios[1] == (1, None)
    ends = {(r["level"], r["start_page"]): r["end_page"] for r in corpus.sections(page).where("chapter = 1").collect()}
    assert ends[1, 0] == 70 and ends[2, 5985 - 5985 % 35] and ends[0, 0] == 1199 * 7
    assert L.section_violations(starts).count() == 0


def test_sections_out_of_order(spark):
    rows = [(1, 1, "1.01", 1), (1, 1, "1.03", 5), (1, 1, "1.02", 9), (1, 0, "1", 1), (2, 0, "2", 0), (1, 1, "1.10", 20)]
    found = {tuple(r) for r in L.section_violations(spark.createDataFrame(rows, "chapter int, level int, section_ref string, start_page int")).collect()}
    assert found == {("book", 0, "2"), ("chapter", 1, "1.02"), ("parent", 1, "1.02"), ("parent", 1, "1.03"), ("parent", 1, "1.10")}


def test_variants_count_after_the_term(spark):
    pages = spark.createDataFrame([(1, "The running rule of runs".split()), (2, None)], "pdf_page long, texts array<string>").withColumn("norms", F.transform("texts", lambda x: F.lower(x)))
    terms = spark.createDataFrame([("rules",), ("of run",)], "term string")
    variants = spark.createDataFrame([("rules", "running rule", 0), ("rules", "rule", 1), ("of run", "rule of", 0), ("of run", "of runs", 1), ("rules", "...", 2)], "term string, variant string, ordinal int")
    got = {tuple(r) for r in V.hits(pages, terms, variants).select("term", "start", "stop", "mode").collect()}
    assert got == {("rules", 2, 2, "lemma"), ("rules", 1, 2, "variant"), ("of run", 3, 4, "lemma"), ("of run", 2, 3, "variant")}


def test_lines(spark):
    places = spark.createDataFrame([("a", "1.02", "8"), ("a", "1.02", "7"), ("a", "1.02", "9"), ("a", "1.10", "3"), ("a", "1.9", "x"), ("b", "2.01", "4"), ("b", "2.01", "4")], "k string, section_ref string, folio string")
    lists = {r["k"]: r["where"] for r in R.locator_lists(places, "k").collect()}
    nb = "\u00a0"
    assert lists == {"a": f"§{nb}1.02 (pp.{nb}7–9), §{nb}1.9 (p.{nb}x), §{nb}1.10 (p.{nb}3)", "b": f"§{nb}2.01 (p.{nb}4)"}
    entries = spark.createDataFrame([("1", "The motion"), ("2", "alibi")], "id string, canonical string")
    where = spark.createDataFrame([("1", "p. 3")], "id string, where string")
    shown = spark.createDataFrame([("1", 2, "second"), ("1", 1, "first")], "id string, rank int, variant string")
    subs = R.sub_lines(spark.createDataFrame([("The motion", "the form"), ("The motion", "cut"), ("The motion", "delay")], "parent string, sub string"), spark.createDataFrame([("The motion", "delay", "p. 9")], "parent string, sub string, where string"), ["cut"])
    synth = R.synthetic_lines(spark.createDataFrame([("motion", "motion to stay"), ("motion", "late motion")], "stem string, canonical string"), spark.createDataFrame([("late motion", "p. 1")], "canonical string, where string"))
    xref = R.xref_lines(spark.createDataFrame([("practice", "motion practice")], "head string, target string"))
    out = [r["line"] for r in R.merged([R.entry_lines(entries, where, shown), subs, synth, xref]).orderBy("letter", "ord").collect()]
    assert out == ["## A", "alibi", "## M", "The motion *(also: first; second)*, p. 3", "    delay, p. 9", "    the form", "motion", "    late motion, p. 1", "    motion to stay", "## P", "practice. See motion practice."]
    pairs = spark.createDataFrame([("rule", "rules", None, "p. 1"), ("party", "parties", "side", None), ("box", "boxes", None, None)], "singular string, plural string, target string, where string")
    assert {r["line"] for r in R.consolidated_lines(pairs).collect()} == {"rule(s), p. 1", "party(ies). See side.", "box(es)"}
    with pytest.raises(ValueError):
        R.recapitalized(pairs, [("frcp", "FRAP")])
    assert R.metadata_block({"b": 1, "a": 2, "built_at": 3}) == ["<!--", "index metadata", "a=2", "b=1", "-->"]


def test_running_heads(spark):
    rows = [("T ABLE OF C ASES", None, "Table OF Cases"), ("I  NDEX 12", "12", "Index"), ("   ", None, None), ("12 P ART  Xii", "XII", "12 Part"), (None, None, None)]
    out = spark.createDataFrame(rows, "head string, folio string, want string").select(T.running_head(F.col("head"), F.col("folio")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in out)


def test_bare_rules_only(spark):
    assert B.parent_rule(spark.createDataFrame([(" FRE 404 ",)], "name string")).first()["term"] == "FRE 404"
    with pytest.raises(Exception, match="bare rule"):
        B.parent_rule(spark.createDataFrame([("FRE 404(b)",)], "name string")).collect()


def test_hash_of_rows_in_any_order(spark):
    rows = [(1, "a"), (2, None), (3, ""), (3, "")]
    of = lambda rows, n: sinks.content_hash(spark.createDataFrame(rows, "a long, b string").repartition(n)).first()[0]
    assert of(rows, 1) == of(rows[::-1], 3) != of(rows[:3], 1) and of(rows, 1) != of([(1, "a"), (2, ""), (3, ""), (3, "")], 1)


@pytest.mark.parametrize("name", ["agg12_evidence_ids", "rnd01_index_lines"])
def test_branches_share_one_search(tmp_path, spark, name):
    """With a checkpoint folder, branches read stored rows: no branch searches the texts again."""
    from foliant.plans import registry

    query, context = registry.queries()[name], spark.sparkContext._jsc.sc()
    want = sorted(map(tuple, query(spark, "/root/testdata/sf0.001").collect()))
    context.setCheckpointDir(str(tmp_path))
    try:
        out = query(spark, "/root/testdata/sf0.001")
        assert sorted(map(tuple, out.collect())) == want
        assert "documents.parquet" not in out._jdf.queryExecution().toString()
    finally:
        field = context.getClass().getDeclaredField("checkpointDir")
        field.setAccessible(True)
        field.set(context, getattr(spark._jvm.scala, "None$").__getattr__("MODULE$"))


def test_subentry_candidates_share_one_search(tmp_path, spark):
    test_branches_share_one_search(tmp_path, spark, "jn17_subentry_candidates")
