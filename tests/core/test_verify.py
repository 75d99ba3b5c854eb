"""Verification, layout, assembly and editorial operators on small tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import citations as C
from foliant.functions import text as T
from foliant.operators import editorial, graph, index, layout, verify


def pages(spark, rows):
    return spark.createDataFrame([(i, t.split(), t.lower().split()) for i, t in rows], "pdf_page long, texts array<string>, norms array<string>")


def found(spark, rows, terms, variants=None):
    v = spark.createDataFrame(variants, "term string, variant string, ordinal int") if variants else None
    return {tuple(r) for r in verify.hits(pages(spark, rows), spark.createDataFrame([(t,) for t in terms], "term string"), v).select("term", "pdf_page", "start", "stop", "mode").collect()}


def test_modes_and_precedence(spark):
    rows = [(1, "the Hearsay Rule and hearsay rules"), (2, "rule hearsay"), (3, "hearsay"), (4, "rule")]
    got = found(spark, rows, ["hearsay rule"], [("hearsay rule", "rule hearsay", 0)])
    assert got == {("hearsay rule", 1, 1, 2, "exact"), ("hearsay rule", 1, 4, 5, "lemma"), ("hearsay rule", 2, 0, 1, "variant")}
    assert found(spark, rows, ["quux zyzzyva", "  "]) == set()


def test_overlapping_hits_stay(spark):
    assert {x[2] for x in found(spark, [(1, "a a a a")], ["a a"])} == {0, 1, 2}


def test_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    vocabulary = ["rule", "rules", "court", "case", "cases", "law"]
    rows = [(i, " ".join(rng.choice(vocabulary, 40))) for i in range(12)]
    terms = sorted({" ".join(rng.choice(vocabulary, n)) for n in (1, 2, 3) for _ in range(6)})
    lemma = {"rules": "rule", "cases": "case"}
    want = set()
    for i, t in rows:
        w = t.split()
        for term in terms:
            q = term.split()
            for s in range(len(w) - len(q) + 1):
                own = w[s : s + len(q)]
                if own == q:
                    want.add((term, i, s, s + len(q) - 1, "exact"))
                elif [lemma.get(x, x) for x in own] == [lemma.get(x, x) for x in q]:
                    want.add((term, i, s, s + len(q) - 1, "lemma"))
    assert found(spark, rows, terms) == want


def test_candidates_are_not_shuffled(spark):
    """A frequent anchor gives a candidate for each of its places; only matches may leave the scan."""
    text = " ".join(["zebra other"] * 50)
    terms = spark.createDataFrame([("zebra one",), ("two zebra",), ("zebra zebra",), ("other zebra",)], "term string")
    out = verify.hits(pages(spark, [(i, text) for i in range(4)]), terms, texts=True)
    assert out.count() == 4 * 49
    plan = re.sub(r"BroadcastExchange|ReusedExchange", "", out._jdf.queryExecution().executedPlan().toString())
    assert "Exchange" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("most", [0, 200_000])
def test_shuffled_phrases_match_like_broadcast_ones(spark, monkeypatch, most):
    """Phrases before the page's first token or past its last one, and variants against brute force, on both ways."""
    monkeypatch.setattr(verify, "BROADCAST_ROWS", most)
    rng = np.random.default_rng(1)
    vocabulary = ["a", "rule", "rules", "hearsay", "zz"]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 30))))) for i in range(20)]
    terms = sorted({" ".join(rng.choice(vocabulary, n)) for n in (1, 2, 3, 4) for _ in range(5)})
    variants = [(t, " ".join(rng.choice(vocabulary, 2)), k) for t in terms for k in range(2)]
    lemma = {"rules": "rule"}
    want = set()
    for i, t in rows:
        w = t.split()
        for term in terms:
            for s in range(len(w)):
                forms = [term.split(), *(v.split() for x, v, _ in sorted(variants, key=lambda r: r[2]) if x == term)]
                for k, q in enumerate(forms):
                    own = w[s : s + len(q)]
                    same, alike = own == q, [lemma.get(x, x) for x in own] == [lemma.get(x, x) for x in q]
                    if same or (alike and k == 0):
                        want.add((term, i, s, s + len(q) - 1, "variant" if k else "exact" if same else "lemma"))
                        break
    assert found(spark, rows, terms, variants) == want


@pytest.mark.parametrize("partitions", ["1", "4", "17"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert len(found(spark, [(i, "one rule two rules") for i in range(9)], ["rule"])) == 18
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_snippet(spark):
    words = [f"word{i}" for i in range(200)]
    df = spark.createDataFrame([(words, 100), (words, 0), (["few", "words"], 0)], "t array<string>, at int")
    near, start, short = (r[0] for r in df.select(verify.snippet(F.col("t"), F.col("at"))).collect())
    assert near.split() == words[70:131] and start.split() == words[:31] and short is None


def test_common_path(spark):
    cases = [([["2.01", "2.01.1"], ["2.01", "2.01.2"]], ["2.01"]), ([["2.01"], ["2.02"]], []), ([["2.01", "2.01.1"]], ["2.01", "2.01.1"]), ([["2.01", "2.01.1"], ["2.01"]], ["2.01"])]
    for paths, want in cases:
        assert spark.createDataFrame([(paths,)], "p array<array<string>>").select(index.common_path(F.col("p"))).first()[0] == want


def test_ranges(spark):
    rows = [("a", "2.04", f) for f in ("78", "79", "80", "82", "iv")] + [("a", "2.05", "81")]
    got = {(r["section_ref"], r["label"]) for r in index.folio_ranges(spark.createDataFrame(rows, "k string, section_ref string, folio string"), ["k"]).collect()}
    assert got == {("2.04", "pp.\u00a078–80"), ("2.04", "p.\u00a082"), ("2.04", "p.\u00a0iv"), ("2.05", "p.\u00a081")}
    refs = spark.createDataFrame([("a", r) for r in ("2.04", "2.05", "2.07", "3.01", "4", "5", "2.04.1")], "k string, section_ref string")
    assert {r["label"] for r in index.section_ranges(refs, ["k"]).collect()} == {"§§2.04–2.05", "§2.07", "§3.01", "§4", "§5", "§2.04.1"}


def test_slugs(spark):
    got = {tuple(r) for r in index.unique_slugs(spark.createDataFrame([("A b",), ("a-b",), ("a  B",), ("!",)], "canonical string")).collect()}
    assert {s for _, s in got} == {"a-b", "a-b-2", "a-b-3", "x"}


def test_citation_offsets(spark):
    text = "é FRE 403(b)(1) then FRE 404 and Fed. R. Civ. P. 12(b)(6); the Twenty-first Amendment"
    hits = spark.createDataFrame([(text,)], "t string").select(F.explode(C.citations(F.col("t"))).alias("c")).select("c.*").collect()
    assert {(h["system"], h["number"], h["path"]) for h in hits} == {("FRE", "403", "(b)(1)"), ("FRE", "404", ""), ("FRCP", "12", "(b)(6)"), ("US Const.", "Twenty-first", "")}
    assert all(text[h["start"] : h["stop"]] == h["surface"] for h in hits)


def test_scalars(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "s string").select(column(F.col("s"))).first()[0]

    assert one(T.normalize, "  ﬁnal “Quote” — x…  ") == 'final "quote" -- x...'
    assert one(T.normalize, one(T.normalize, "A  ﬃ b")) == one(T.normalize, "A  ﬃ b")
    assert [one(T.folio_int, f) for f in ("iv", "XIX", "12", "A-3", "mcmxcix", None)] == [4, 19, 12, 3, 1999, None]
    assert one(T.title_case, "MOTION TO COMPEL: THE BASICS OF IT") == "Motion to Compel: The Basics of It"
    assert one(T.heading_phrases, "Describe the Burden of Proof") == ["burden of proof"]
    assert one(T.heading_phrases, "Why Be an Advocate") == []
    assert one(T.case_sort_key, "in RE Smith") == "Smith"


def test_folio_fill(spark):
    rows = [("c", 1, "5", False), ("c", 2, None, False), ("c", 3, "7", False), ("c", 4, None, True), ("c", 5, None, False), ("c", 6, "9", False), ("c", 7, None, False), ("c", 8, "30", False)]
    got = {r["ordinal"]: (r["folio"], r["reason"]) for r in layout.fill_folios(spark.createDataFrame(rows, "k string, ordinal int, folio string, blank boolean"), ["k"]).collect()}
    assert got[2] == ("6", "contiguous_fill") and got[4] == (None, "blank_page") and got[5] == ("8", "chapter_start_or_blank") and got[7] == (None, "open")


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7)], "src long, dst long")
    left = {tuple(r) for r in graph.on_cycles(edges).collect()}
    assert {(1, 2), (2, 3), (3, 1), (5, 5)} <= left and (6, 7) not in left
    assert graph.on_cycles(edges.where("src > 5")).count() == 0


def test_cycles_of_a_long_chain(spark):
    """A chain of 134 edges takes 67 rounds to peel, more than the 64 that were the cap."""
    chain = [(i, i + 1) for i in range(134)]
    edges = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    assert graph.on_cycles(edges(chain)).count() == 0
    assert {tuple(r) for r in graph.on_cycles(edges(chain[:9] + [(900, 901), (901, 900)])).collect()} == {(900, 901), (901, 900)}


def test_section_path_of_a_deep_chain(spark):
    ids = [0] + [10**k for k in range(8)]
    rows = [(i, None if i < 10 else i // 10) for i in ids] + [(77, 70)]  # 70 is no section
    got = {r["section_id"]: (r["root"], r["depth"]) for r in graph.section_path(spark, spark.createDataFrame(rows, "section_id long, parent_id long")).collect()}
    assert got == {0: (0, 0), 77: (70, 1)} | {10**k: (1, k) for k in range(8)}
    with pytest.raises(ValueError, match="cycle"):
        graph.section_path(spark, spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "section_id long, parent_id long"))


def test_editorial_rules_are_idempotent(spark):
    entries = spark.createDataFrame([("1", "witness", ["expert"]), ("2", "frcp", []), ("3", "Motion", ["motions"]), ("4", "cut me", []), ("5", "artifact .", ["art"])], "id string, canonical string, variants array<string>")
    places = spark.createDataFrame([("1", "2.01", "9"), ("5", "4.01", "1"), ("5", "2.01", "9"), ("4", "6.01", "5")], "id string, section_ref string, folio string")
    rules = spark.createDataFrame([("R1", "witness", None), ("R2", "FRCP", "FRCP"), ("R3", "Motion", "motion"), ("R4", "cut me", None), ("R7", "artifact .", "witness")], "rule string, term string, target string")
    once = editorial.apply_rules(entries, places, rules, allow_stale=True)[:2]
    twice = editorial.apply_rules(*once, rules, allow_stale=True)[:2]
    for a, b in zip(once, twice, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert {tuple(r) for r in once[1].collect()} == {("1", "2.01", "9"), ("1", "4.01", "1")}


def test_replay_and_stream(spark, tmp_path):
    from foliant import cli
    from foliant.streaming.incremental import arrays, verify_stream

    rng = np.random.default_rng(1)
    docs = [(i, "src%d" % (i % 2), " ".join(rng.choice(["alpha", "beta", "gammas", "gamma"], 60)), 300) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, source string, text string, n_chars long").write.parquet(f"{tmp_path}/t/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/t/benchmark.parquet")
    assert cli.replay(spark, f"{tmp_path}/t", f"{tmp_path}/out")
    assert re.search("^alpha beta gamma, §\u00a0", (tmp_path / "out/index.md").read_text(), re.M)
    stream = spark.readStream.schema("doc_id long, source string, text string, n_chars long").parquet(f"{tmp_path}/t/documents.parquet")
    terms = spark.createDataFrame([("alpha beta",)], "term string")
    verify_stream(stream, terms, f"{tmp_path}/hits", f"{tmp_path}/cp").awaitTermination()
    batch = verify.hits(arrays(spark.read.parquet(f"{tmp_path}/t/documents.parquet")), terms)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/hits").drop("batch").collect()} == {tuple(r) for r in batch.collect()}


def test_variants_are_settled_without_a_shuffle(spark):
    """The first alternative at a start is told beside the page, not by a window over all matches; two of one ordinal and repeated ones count once."""
    text = " ".join(["rule of court"] * 20)
    terms = spark.createDataFrame([("rule of",), ("of court",)], "term string")
    variants = spark.createDataFrame([("rule of", "rule", 0), ("rule of", "court", 1), ("rule of", "of", 1), ("rule of", "of court", 1), ("rule of", "of", 1)], "term string, variant string, ordinal int")
    out = verify.hits(pages(spark, [(i, text) for i in range(3)]), terms, variants)
    counts = {(r["term"], r["mode"]): r["count"] for r in out.groupBy("term", "mode").count().collect()}
    assert counts == {("rule of", "exact"): 60, ("rule of", "variant"): 120, ("of court", "exact"): 60}
    plan = re.sub(r"BroadcastExchange|ReusedExchange", "", out._jdf.queryExecution().executedPlan().toString())
    assert "Window" not in plan


@pytest.mark.parametrize("most", [0, 8])
def test_more_alternatives_than_are_told_beside_the_page(spark, monkeypatch, most):
    monkeypatch.setattr(verify, "EARLIER_FORMS", most)
    rows = [(1, "rules rule a b a"), (2, "b a rule")]
    got = found(spark, rows, ["rule", "a b"], [("rule", "rules", 0), ("rule", "a", 1), ("a b", "a", 0), ("a b", "b a", 1)])
    assert got == {("rule", 1, 0, 0, "lemma"), ("rule", 1, 1, 1, "exact"), ("rule", 1, 2, 2, "variant"), ("rule", 1, 4, 4, "variant"), ("rule", 2, 1, 1, "variant"), ("rule", 2, 2, 2, "exact"), ("a b", 1, 2, 3, "exact"), ("a b", 1, 3, 4, "variant"), ("a b", 1, 4, 4, "variant"), ("a b", 2, 0, 1, "variant"), ("a b", 2, 1, 1, "variant")}
