"""The ten operators against brute force on small tables with nulls, empty texts, copies, ties and clashing columns."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import chat, crf, decontaminate, katz, mixing, neardup, quality, queries, secrets, sharding, substrings
from foliant.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = {
    "en": "the of and to in is was that for on with river stone house green walking under cloud letter morning paper window garden".split(),
    "de": "der die und in den von mit sich des auf haus straße grün wolke brief morgen papier fenster garten läuft unter stein".split(),
}


def made_texts():
    rng = np.random.default_rng(5)
    out = []
    for i in range(40):
        lang = "en" if i % 2 else "de"
        n = int(rng.integers(1, 260))
        words = [str(w) + (str(rng.integers(0, 9)) if rng.random() < 0.5 else "") for w in rng.choice(VOCABULARY[lang], n)]
        out.append((i, " ".join(words), lang, f"s{i % 3}"))
    base = out[3][1].split() * 2
    for i in range(40, 52):  # near copies of growing distance
        words = list(base)
        for j in rng.integers(0, len(words), i - 39):
            words[j] = f"edit{i}{j}"
        out.append((i, " ".join(words), "en", None))
    out += [(52, out[5][1], "en", "s1"), (53, out[5][1], "de", "s0"), (54, None, None, None), (55, "", "en", "s2"), (56, "  \n\t ", "de", "s2"), (57, "one two", "en", "s2"), (58, "One TWO", None, "s2")]
    out += [(59, "ab" * 900, "en", "s0"), (60, "é" * 700 + out[7][1], "de", "s0"), (61, "\n".join(["same line here"] * 30), "en", "s1")]
    return out


DOCS = made_texts()


@pytest.fixture(scope="module")
def docs(spark):
    # Columns that clash with working names of the operators.
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in ("shard", "quality", "secrets", "_key", "h", "times")}).repartition(3)


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_quality(spark, docs):
    rows = {r["doc_id"]: r["_quality"] for r in quality.judged(docs).collect()}
    for doc_id, text, _, _ in DOCS:
        t, w, seen, repeated = text or "", WORD.findall(text or ""), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                repeated += line in seen
                seen.add(line)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            if count[g] > 1:
                covered |= {i, i + 1, i + 2}
        q = rows[doc_id]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(covered))
        assert q["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (q["base_failed"] and q["kept"])


def test_quality_rejects_symbols_and_keeps_prose(spark):
    rng = np.random.default_rng(1)
    clean = [(i, " ".join(rng.choice(VOCABULARY["en"], 30)) + " " + " ".join(f"w{rng.integers(9**6)}" for _ in range(60)), "en") for i in range(30)]
    junk = [(99, " ".join(f"{rng.integers(9**6)}$$$###%%%&&&" for _ in range(90)), "en")]
    kept = {r["doc_id"] for r in quality.judged(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).where("quality.kept").collect()}
    assert kept == {i for i, _, _ in clean}


def test_quality_rejects_word_salad(spark):
    """Invented words joined by ' | ' look like prose by their characters; only the common words tell."""
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join(str(rng.choice(VOCABULARY["en"][:10])) if rng.random() < 0.2 else "".join(rng.choice(list("abcdefghilmnoprstu"), 6)) for _ in range(n))
    salad = lambda n: "".join("".join(rng.choice(list("abcdefghilmnoprstu"), 7)) + (" | " if i % 4 == 0 else " ") for i in range(n))
    rows = [(i, prose(200), "en") for i in range(30)] + [(100 + i, salad(80 + i), "en") for i in range(5)]
    judged = {r["doc_id"]: r["quality"] for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(judged[100 + i]["class_distance"] < quality.Rules().class_distance for i in range(5))
    assert {i for i, q in judged.items() if q["kept"]} == set(range(30))


def test_language(spark, docs):
    out = {r["doc_id"]: r for r in crf.labelled(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2).collect()}
    assert len(out) == len(DOCS)
    held = [(out[i]["lang_pred"], lang) for i, text, lang, _ in DOCS if i < 40 and zlib.crc32(str(i).encode()) % 4 == 2 and len(text) > 100]
    assert held and sum(a == b for a, b in held) >= 0.9 * len(held)
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (54, 55, 56))
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    k, first = 3, np.array([0, 1, 1, 6, 75])
    scores, transitions = rng.normal(size=(75, k)), rng.normal(size=(k, k))
    post = crf.posteriors(scores, first, transitions)
    step = np.exp(transitions)
    for a, b in zip(first[:-1], first[1:], strict=True):
        e = np.exp(scores[a:b])
        alpha, state = [], np.ones(k)
        for t, x in enumerate(e):
            state = (state @ step if t else state) * x
            state /= state.sum()
            alpha.append(state)
        state = np.ones(k)
        for t in range(b - a - 1, -1, -1):
            want = alpha[t] * state
            assert np.allclose(post[a + t], want / want.sum())
            state = step @ (e[t] * state)
            state /= state.sum()


def test_gradient_is_that_of_the_likelihood():
    """Against finite differences of a likelihood that is added up over all label sequences."""
    texts, truth = ["river stone the", "der haus of und", "x"], np.array([0, 0, 1, 2, 1, 0, 2, 1])
    rng = np.random.default_rng(8)
    model = crf.Crf(["a", "b", "c"], rng.normal(size=(3, crf.GRAM_BUCKETS, 3)).astype(np.float64) / 4, rng.normal(size=(crf.WORD_BUCKETS, 3)).astype(np.float64) / 4, rng.normal(size=(3, 3)))

    def loss():
        scores, first = crf.emissions(model, texts)
        out = 0.0
        for a, b in zip(first[:-1], first[1:], strict=True):
            path = lambda ys: sum(scores[a + t, y] for t, y in enumerate(ys)) + sum(model.transitions[x, y] for x, y in itertools.pairwise(ys))  # noqa: E731, B023
            out += math.log(sum(math.exp(path(ys)) for ys in itertools.product(range(3), repeat=b - a))) - path(truth[a:b].tolist())
        return out / len(truth)

    for weights, slope in zip((model.grams, model.words, model.transitions), crf.gradient(model, texts, truth), strict=True):
        for at in [tuple(x) for x in np.argwhere(slope != 0)[:12]]:
            kept, step = weights[at], 1e-5
            weights[at] = kept + step
            above = loss()
            weights[at] = kept - step
            below = loss()
            weights[at] = kept
            assert math.isclose((above - below) / (2 * step), slope[at], rel_tol=1e-4, abs_tol=1e-7)
    with pytest.raises(ValueError):
        crf.gradient(model, texts, truth[:-1])


def test_long_texts_are_chained(spark):
    rng = np.random.default_rng(4)
    model = crf.fit([(lang, " ".join(rng.choice(VOCABULARY[lang], 200))) for lang in VOCABULARY for _ in range(10)])
    text = " ".join(str(w) for i in range(12) for w in rng.choice(VOCABULARY["en" if i % 3 else "de"], 40)) + "\n  \t"
    whole = crf.posteriors(*crf.emissions(model, [text]), model.transitions)
    assert np.allclose(np.concatenate(list(crf.long_posteriors(model, text, 300))), whole)
    rows = [(None, text, "en"), (1, text * 3, "de"), (1, None, None), (2, " " * 5000, "en"), (3, "1 2 3", "de"), (4, "x" * 9000, "en"), *((i, " ".join(rng.choice(VOCABULARY["en" if i % 2 else "de"], 60)), "en" if i % 2 else "de") for i in range(10, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = [sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 9), str(r["runs"])) for r in crf.labelled(docs, F.col("doc_id") >= 10, segment_bytes=n).collect()) for n in (1000, 1_000_000)]
    assert out[0] == out[1] and len(out[0]) == len(rows)
    assert {r[1] for r in out[0] if r[0] in ("2", "3")} == {"und"}


def test_code_switching():
    rng = np.random.default_rng(3)
    model = crf.fit([(lang, " ".join(rng.choice(VOCABULARY[lang], 200))) for lang in VOCABULARY for _ in range(20)])
    words = list(rng.choice(VOCABULARY["en"], 15)) + list(rng.choice(VOCABULARY["de"], 15))
    scores, first = crf.emissions(model, [" ".join(words)])
    best = [model.labels[i] for i in crf.posteriors(scores, first, model.transitions).argmax(axis=1)]
    assert sum(b == w for b, w in zip(best, ["en"] * 15 + ["de"] * 15, strict=True)) >= 27


class Brute:
    """A Katz model over lists of tokens, counted in dictionaries and evaluated one token at a time."""

    def __init__(self, texts, order):
        self.order, self.grams, self.context = order, defaultdict(Counter), defaultdict(Counter)
        for words in texts:
            run = ["\1"] * (order - 1) + words
            for t in range(order - 1, len(run)):
                for k in range(1, order + 1):
                    self.grams[k][tuple(run[t - k + 1 : t + 1])] += 1
                    self.context[k][tuple(run[t - k + 1 : t])] += 1
        self.n, self.v = sum(self.grams[1].values()), len(self.grams[1])
        of = {k: Counter(self.grams[k].values()) for k in range(2, order + 1)}
        self.d = {k: katz.discounts([of[k][i] for i in range(1, 7)]) for k in of}
        self.followers = defaultdict(list)
        for k in range(2, order + 1):
            for g in self.grams[k]:
                self.followers[g[:-1]].append(g[-1])
        self.alphas = {}

    def used(self, g):
        c = self.grams[len(g)][g]
        return (self.d[len(g)][c - 1] if c <= 5 else 1.0) * c

    def below(self, h):
        k = len(h) + 1
        kept = all(c > 5 or self.d[k][c - 1] == 1 for c in (self.grams[k][(*h, w)] for w in self.followers[h]))
        return self.context[k][h] + kept

    def alpha(self, h):
        if h not in self.followers:
            return 1.0
        if h not in self.alphas:
            own = sum(self.used((*h, w)) for w in self.followers[h]) / self.below(h)
            self.alphas[h] = (1 - own) / (1 - sum(self.p((*h[1:], w)) for w in self.followers[h]))
        return self.alphas[h]

    def p(self, g):
        if len(g) == 1:
            return (self.grams[1][g] + 1) / (self.n + self.v + 1)
        if self.grams[len(g)][g]:
            return self.used(g) / self.below(g[:-1])
        return self.alpha(g[:-1]) * self.p(g[1:])

    def score(self, words):
        run = ["\1"] * (self.order - 1) + words
        return sum(math.log10(self.p(tuple(run[t - self.order + 1 : t + 1]))) for t in range(self.order - 1, len(run)))


TOKENS = {i: WORD.findall((t or "").translate(LOWER)) + ["\0"] for i, t, _, _ in DOCS}


@pytest.mark.parametrize(("order", "segment_bytes"), [(2, 4_000_000), (2, 300), (3, 250), (1, 4_000_000)])
def test_katz(spark, docs, order, segment_bytes):
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    out = {r["doc_id"]: r for r in katz.scored(docs, train, order=order, block_tokens=700, segment_bytes=segment_bytes).collect()}
    assert len(out) == len(DOCS)
    learned = {i for i in TOKENS if zlib.crc32(str(i).encode()) % 7 != 2}
    model = Brute([TOKENS[i] for i in sorted(learned)], order)
    for h in list(model.followers):  # every distribution adds up to 1, the unknown word included
        assert math.isclose(sum(model.p((*h, *w)) for w in model.grams[1]) + model.p((*h, "never seen")), 1.0)
    for i, words in TOKENS.items():
        r = out[i]
        base = sum(math.log10((model.grams[1][w,] + 1) / (model.n + model.v + 1)) for w in words)
        assert math.isclose(r["score"], model.score(words), abs_tol=1e-7) and math.isclose(r["base_score"], base, abs_tol=1e-7)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in learned, len(words), sum(model.grams[1][w,] > 0 for w in words), model.n)


def test_katz_tables_score_fresh_texts(spark, docs):
    model = katz.trained(docs.where("doc_id < 30"), order=3)
    held = {(r["order"], r["count"]) for r in model.ngrams().collect()}
    brute = Brute([TOKENS[i] for i in range(30)], 3)
    assert held == {(k, c) for k in (1, 2, 3) for c in brute.grams[k].values()}
    out = {r["doc_id"]: r["score"] for r in katz.scores(model, docs.where("doc_id >= 25")).collect()}
    assert sorted(out) == list(range(25, 62))
    assert all(math.isclose(out[i], brute.score(TOKENS[i]), abs_tol=1e-7) for i in out)


def test_katz_of_odd_rows(spark):
    """Null and repeated keys, a long text of one word, one of spaces only, and nothing to learn from."""
    rows = [(None, "a b"), (None, "a b"), (7, "a b"), (7, None), (8, "x" * 5000), (9, " " * 5000), (10, "a " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = katz.scored(docs, F.lit(True), segment_bytes=400).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out) == [("10", 3001), ("7", 1), ("7", 3), ("8", 2), ("9", 1), ("None", 3), ("None", 3)]
    assert len({r["score"] for r in out if r["n_tokens"] == 3}) == 1
    none = katz.scored(docs, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in none)


def test_discounts_rise():
    assert katz.discounts([0] * 6) == katz.discounts([5, 0, 0, 0, 0, 0]) == [1.0] * 5
    for n in ([1000, 300, 150, 90, 60, 45], [1000, 400, 90, 95, 30, 31], [1000, 30, 500, 20, 30, 1]):
        d = katz.discounts(n)
        assert d == sorted(d) and 0 < d[0] and d[-1] <= 1


def test_sharding(spark, docs):
    slots, stats = sharding.build_map(docs, 5)
    rows = sharding.positions(docs, slots, stats).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for shard in by.values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
    texts = {i: t or "" for i, t, _, _ in DOCS}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    loads = [sum(r["size"] for r in s) for s in by.values()]
    assert max(loads) - min(loads) <= max(r["size"] for r in rows)
    assert {(r["doc_id"], r["_shard"]) for r in sharding.assign(docs, slots).collect()} == {(r["doc_id"], r["shard"]) for r in rows}
    load = {s: b for s, (b, _) in stats.items()}
    grown = sharding.rebalance(slots, load, 6)
    assert grown.version == 2 and sum(a != b for a, b in zip(slots.shard, grown.shard, strict=True)) < len(load)
    assert all(b == 5 or a == b or load.get(s) for s, (a, b) in enumerate(zip(slots.shard, grown.shard, strict=True)))


def test_mixing(spark, docs):
    rows = mixing.select_blocks(docs, block=8).collect()
    assert len(rows) == len(DOCS) and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.select_blocks(docs.repartition(7), block=8).collect()), key=str)
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(WORD.findall(next(t or "" for i, t, _, _ in DOCS if i == r["doc_id"]))) and 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    assert math.isclose(sum(s[0]["target"] for s in by.values()), 1.5 * sum(r["size"] for r in rows))
    for s in by.values():
        assert s[0]["target"] <= 2 * s[0]["source_size"] and abs(sum(r["taken"] for r in s) - s[0]["target"]) <= 16


def test_shards_take_their_quotas(spark, docs):
    rows, block = mixing.select_blocks(docs, block=8, n_shards=5).collect(), 8
    sizes = spark.createDataFrame([(r["source"], r["size"]) for r in rows], "source string, size long")
    plan = mixing.source_plan(sizes, "source", "size", block)
    quotas = mixing.shard_quotas(plan, sum(s.seats for s in plan), 5, block)
    for i, s in enumerate(plan):
        for j in range(5):  # a quota is whole blocks, of which only the last of a source's line is short
            got = sum(r["by_shard"][j] for r in rows if r["source"] == s.name)
            assert quotas[j][i] * block - 2 * block < got <= quotas[j][i] * block
    assert all(sum(r["by_shard"]) == r["taken"] for r in rows)


def test_mix_of_null_and_repeated_keys(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text, "a", 1), (None, text, "a", 2), (None, text + " x", "a", 3), (7, text, "a", 4), (7, text, "a", 5), (8, None, "a", 6), (9, "", None, 7), *((i, text, "b", i) for i in range(20, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    out = mixing.mixed(docs)
    got = Counter(tuple(r) for r in out.collect())
    assert out.columns == docs.columns and set(got) <= set(rows) and max(got.values()) <= 2
    assert abs(sum(got.values()) - 1.5 * 25) <= 3
    assert got == Counter(tuple(r) for r in mixing.mixed(docs.repartition(5)).collect())
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_stored_slot_map(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    slots, stats = sharding.stored_map(docs, 5, path)
    assert slots == sharding.build_map(docs, 5)[0] and sharding.load_map(spark, path) == slots
    grown = sharding.rebalance_stored(docs, path, 6)
    assert grown.version == 2 and sharding.load_map(spark, path) == grown and sharding.load_map(spark, path, 1) == slots
    assert grown == sharding.rebalance(slots, {s: b for s, (b, _) in stats.items()}, 6)
    with pytest.raises(Exception, match="exist"):
        sharding.save_map(spark, slots, path)


def test_turns_are_streamed(spark):
    long = "é<|end|>\\ " * 70
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 2, "assistant", None), (1, 2, "user", "tie"), (None, 0, None, "x"), (2, 5, "assistant", ""), (2, 5, "assistant", "")]
    events = chat.from_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 13)
    assert events.where("kind = 'delta'").count() == 3 + -(-len(long) // 13) and events.select("conv_id", "seq").distinct().count() == events.count()
    out = chat.render(chat.fold_events(events)).withColumns({"told": chat.parse(F.col("formatted")), "loss": chat.loss_texts(F.col("formatted"), F.col("loss_spans"))})
    rows = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in rows[1]["told"]] == [("user", "hi"), ("assistant", long), ("assistant", ""), ("user", "tie")]
    assert rows[1]["loss"] == [long, ""] and rows[2]["loss"] == ["", ""] and [(t["role"], t["text"]) for t in rows[None]["told"]] == [("", "x")]
    assert chat.render(chat.fold_events(events.limit(0))).count() == 0


def test_apportionment_is_by_highest_quotients():
    rng = np.random.default_rng(4)
    for _ in range(20):
        plan = [mixing.Source(str(i), int(s), 1, mixing.Fraction(int(s))) for i, s in enumerate(rng.integers(1, 5000, 6))]
        quotients = sorted(((-s.target / (2 * k + 1), i) for i, s in enumerate(plan) for k in range(200)))[:97]
        assert mixing.apportion(plan, 97, 1) == [sum(i == j for _, j in quotients) for i in range(6)]
        quotas = mixing.shard_quotas(plan, 97, 4, 1)
        assert [sum(q[i] for q in quotas) for i in range(6)] == mixing.apportion(plan, 97, 1) and min(min(q) for q in quotas) >= 0


def test_secrets(spark):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
    texts = [
        "AKIAABCDEFGHIJKL12 then " + key + " at https://vault.example.com/x",  # all three parts
        key + " alone is weak",
        "AKIAABCDEFGHIJKL12" + " far" * 80 + " " + key,
        "password: token: abcdefghij", "API_KEY = \"abc/def+123=\" and " + "0123456789abcdef" * 2, "see https://example.com only", "", None, "é token=ééé token='abcdefgh' x",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["secrets"]] for r in secrets.scan(docs).collect()}
    base = (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))
    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, p, least, g in zip(("assign", "access", "hex"), base, (8, 16, 32), (2, 0, 0), strict=True) for m in p.finditer(t or "") if len(m[g]) >= least]
        assert [s for s in got[i] if s[0] in ("assign", "access", "hex")] == sorted(want, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
    assert {s[0] for s in got[0]} == {"access", "key_secret", "endpoint"}
    assert got[1] == [] and {s[0] for s in got[2]} == {"access"} and got[5] == []


def test_substrings(spark, docs):
    out = {r["doc_id"]: r for r in substrings.without_repeats(docs).collect()}
    raw, count = [(i, (t or "").encode()) for i, t, _, _ in DOCS], Counter()
    for _, b in raw:
        count.update(b[i : i + 400] for i in range(len(b) - 399))
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - 399):
            if count[b[j : j + 400]] > 1:
                gone[j : j + 400] = True
        assert (out[i]["n_bytes"], out[i]["n_removed"], len(out[i]["spans"])) == (len(b), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0)
        assert bytes(out[i]["kept"]) == bytes(x for x, g in zip(b, gone, strict=False) if not g)


def test_substrings_query(spark, tmp_path):
    """The columns of the contract come first; what remains is told byte by byte, also where a cut splits a character."""
    rng = np.random.default_rng(7)
    run, short = ("".join(rng.choice(list("abcdefgh "), n)) for n in (500, 399))
    rows = [(0, "one " + run + " end"), (1, "two " + run), (2, "\u00e9" + short), (3, "\u0129" + short), (4, "a" + short + "\u00e9"), (5, "b" + short + "\u00ea"), (6, None), (7, ""), (8, "alone")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op7_prefix_doubling(spark, str(tmp_path))
    assert out.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    count, got = Counter(), {r["doc_id"]: r for r in out.collect()}
    raw = {i: (t or "").encode() for i, t in rows}
    for b in raw.values():
        count.update(b[i : i + 400] for i in range(len(b) - 399))
    for i, b in raw.items():
        gone = {k for j in range(len(b) - 399) if count[b[j : j + 400]] > 1 for k in range(j, j + 400)}
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), len(gone), sum(k - 1 not in gone for k in gone))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest() and r["text"] == kept.decode(errors="replace")
    assert len(got) == len(rows) and "\ufffd" in got[2]["text"] and "\ufffd" in got[4]["text"]


def test_chat(spark):
    events = [
        (1, 1, 1, "create", "user", "hi <|end|> \\ </s>"), (1, 2, 2, "create", "assistant", "wrong"), (1, 3, 2, "regenerate", None, ""), (1, 4, 2, "delta", None, "good "), (1, 6, 2, "delta", None, "[INST]"), (1, 5, 2, "delta", None, "day "),
        (1, 7, 3, "create", "user", None), (1, 8, 3, "edit", None, "edited"), (1, 9, 4, "create", "user", "gone"), (1, 10, 4, "delete", None, None), (2, 1, 1, None, None, ""), (None, 1, 1, "create", "assistant", "é"),
    ]
    out = chat.render(chat.fold_events(spark.createDataFrame(events, "conv_id long, seq long, message long, kind string, role string, text string")))
    rows = {r["conv_id"]: r for r in out.withColumn("parsed", chat.parse(F.col("formatted"))).collect()}
    assert [(t["role"], t["text"]) for t in rows[1]["parsed"]] == [("user", "hi <|end|> \\ </s>"), ("assistant", "good day [INST]"), ("user", "edited")]
    assert [(t["role"], t["text"]) for t in rows[2]["parsed"]] == [("", "")]
    for r in rows.values():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert [r["formatted"][s["start"] : s["stop"]] for s in r["loss_spans"]] == [s["text"] for s in r["segments"] if s["loss"]]
        assert "</s>" not in r["formatted"] and "[INST]" not in r["formatted"]


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_containment(spark, docs, broadcast_rows):
    items = [(1, " ".join(DOCS[9][1].split()[2:22])), (2, "one two"), (3, None), (4, ""), (5, " ".join(DOCS[9][1].split()[2:15] + ["other"] * 9)), (6, " ".join(DOCS[9][1].split()[2:22]).upper())]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["found"], r["n"]) for r in decontaminate.contained(docs, table, broadcast_rows=broadcast_rows).collect()}
    want = set()
    for i, t, _, _ in DOCS:
        own = shingle_set(t)
        for k, s in items:
            wanted = shingle_set(s)
            if wanted and 100 * len(own & wanted) >= 75 * len(wanted):
                want.add((i, k, len(own & wanted), len(wanted)))
    assert got == want and want
    if broadcast_rows:
        assert {r["doc_id"] for r in decontaminate.clean(docs, table).collect()} == {i for i, *_ in DOCS} - {w[0] for w in want}


def brute_components(rows):
    sets, parent = {i: shingle_set(t) for i, t, *_ in rows}, {i: i for i, *_ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(spark, docs, monkeypatch):
    want = brute_components(DOCS)
    for block in (neardup.BLOCK_MEMBERS, 3):  # few and many blocks
        monkeypatch.setattr(neardup.within_families, "__defaults__", (block, neardup.BROADCAST_ROWS))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.linked(docs).collect()}
        assert got == want
    assert {r["doc_id"] for r in neardup.deduplicated(docs).collect()} == {i for i, (_, c) in want.items() if i == c}


def test_near_duplicates_of_one_chain(spark):
    """Each text shares enough with the next one only, so links must not be lost to hubs."""
    rng = np.random.default_rng(8)
    words, rows = [f"w{i}" for i in range(120)], []
    for i in range(30):
        rows.append((i, " ".join(words), "en", "s"))
        for j in rng.choice(120, 2, replace=False):
            words[j] = f"x{i}_{j}"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.linked(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == brute_components(rows)


def test_signatures_meet_within_the_threshold():
    """Any two signatures with at most MOST_ERRORS different symbols share a key."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**16, neardup.N_SYMBOLS).astype(np.uint16)
    sigs = [base]
    for _ in range(200):
        other = base.copy()
        other[rng.choice(neardup.N_SYMBOLS, neardup.MOST_ERRORS, replace=False)] ^= np.uint16(1)
        sigs.append(other)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sigs)), pa.int64()), pa.array([s.tobytes() for s in sigs])], names=["doc_id", "sig"])
    keys = next(neardup._keys(iter([batch])))
    table = np.array(keys.column("key")).reshape(len(sigs), -1)
    assert all((row == table[0]).any() for row in table)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 5), (7, 7), (20, 5)]
    got = {(r["node"], r["component"]) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(2, 1), (3, 1), (9, 1), (6, 5), (20, 5)}


def test_empty_tables(spark, docs):
    none, items = docs.where("false"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    train = F.lit(True)
    assert quality.judged(none).count() == 0 and crf.labelled(none, train).count() == 0 and katz.scored(none, train).count() == 0
    slots, stats = sharding.build_map(none, 4)
    assert sharding.assign(none, slots).count() == 0 and sharding.positions(none, slots, stats).count() == 0
    assert mixing.select_blocks(none).count() == 0 and secrets.scan(none).count() == 0 and substrings.without_repeats(none).count() == 0
    assert decontaminate.contained(none, items).count() == 0 and decontaminate.contained(docs, items.where("false")).count() == 0
    assert neardup.linked(none).count() == 0


def test_hashes_are_the_same_in_any_piece():
    from foliant.llm import tokens

    text = "Straße  WORD word\n x" * 3
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, stops, _ = tokens.word_spans(raw, np.array([0, len(raw)]))
    hashes = tokens.word_hashes(raw, starts, stops)
    assert [text.encode()[a:b].decode() for a, b in zip(starts, stops, strict=True)] == text.split()
    assert hashes[1] == hashes[2] and len(set(hashes.tolist())) == len({w.lower() for w in text.split()})
    assert hashlib.sha256(hashes.tobytes()).hexdigest() == hashlib.sha256(tokens.word_hashes(raw.copy(), starts, stops).tobytes()).hexdigest()


def test_secrets_of_a_very_long_endpoint(spark):
    """The identifier and the secret lie after the end of a URL that holds over 126 candidates, or a long identifier holds as many."""
    weak_id, weak_secret = "ABCDEFGH12345678", "aB3" * 12
    url = "https://h.example/" + "/".join(["QWERTYUI87654321"] * 400)
    digits = "AKIA" + "A".join(["1234567890" * 4] * 200)
    rows = [(1, f"{url} {weak_secret}"), (2, f"{digits} {weak_secret}"), (3, f"{url} {'x ' * 150}{weak_secret} {weak_id}")]
    found = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["secrets"]] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ("endpoint", url) in found[1] and ("key_secret", weak_secret) in found[1]
    assert ("key_secret", weak_secret) in found[2]
    assert ("endpoint", url) not in found[3]


def brute_secrets(text, scope=secrets.SCOPE):
    """Spans by re, and the link rule by looking at all pairs."""
    found = {}
    for k in secrets.KINDS:
        for m in re.finditer(k.pattern, text):
            v = m.group(k.group)
            if k.least <= len(v) <= k.most and all(re.search(n, v) for n in k.needs):
                found.setdefault(k in secrets.WEAK, []).append((m.start(), secrets.KINDS.index(k), m.end(), k.name, k.part))
    strong = found.get(False, [])
    weak = [w for w in found.get(True, []) if not any(s[0] < w[2] and w[0] < s[2] for s in strong)]
    every = sorted(strong + weak)

    def linked(x):
        near = {y[4] for y in every if y[0] < x[2] + scope and x[0] < y[2] + scope}
        return x in strong or {"id": {"secret"}, "secret": {"id"}, "endpoint": {"id", "secret"}}[x[4]] <= near

    return [(x[3], x[0], x[2]) for x in every if linked(x)]


def test_secrets_against_all_pairs(spark):
    """Random texts of parts and gaps around the scope, among them some with more candidates than a chunk has and a very long one."""
    rng = np.random.default_rng(3)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))

    def part():
        kind = rng.integers(0, 7)
        if kind == 0:
            return "AKIA" + pick(up + digits, int(rng.integers(8, 20)))
        if kind == 1:
            return pick(up + digits, int(rng.integers(12, 36)))
        if kind == 2:
            return pick(low + up + digits, int(rng.integers(28, 95)))
        if kind == 3:
            return "https://" + pick(low + digits, int(rng.integers(1, 400))) + ".example/"
        if kind == 4:
            return pick("0123456789abcdef", int(rng.integers(28, 40)))
        if kind == 5:
            return str(rng.choice(["password", "API_KEY", "token", "secret"])) + str(rng.choice([": ", "=", " = '"])) + pick(low + digits, int(rng.integers(5, 14)))
        return "plain é words"

    texts = [" ".join(x for _ in range(int(n)) for x in (part(), "." * int(rng.choice([0, 3, 150, 190, 199, 200, 201, 230])))) for n in [*rng.integers(0, 14, 120), 700, 900]]
    texts += ["AKIA" + ("1" * 32 + "Z") * 150 + " ..... " + pick(low + up + digits, 40), ("AKIA" + "9" * 16 + " ") * 3000, "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["secrets"]] for r in secrets.scan(docs).collect()}
    added = 0
    for i, t in enumerate(texts):
        want = brute_secrets(t or "")
        assert out[i] == want
        added += sum(k in ("key_id", "key_secret", "endpoint") for k, _, _ in want)
    assert added > 100
