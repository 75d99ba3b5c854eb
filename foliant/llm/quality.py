"""Quality rules by distribution divergence.

Two histograms of a document, of character classes and of common words, are compared with the
references of each language by Jensen-Shannon distance (base 2, from 0 to 1). The references are the
integer sums of the histograms of all documents of a language that are long enough, so they do not
depend on the order of rows. A document passes if some language is near enough in both. Guards of
least length keep short texts from being judged on noise.

Cost: two scans, no shuffle but the sums of one row for each language of LEXICON. All work on a
text stays in its row: repeated windows are found by sorting the hashes of the windows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import SPACE, WORD, fresh, int_array, pinned, words

#: Common words of each language.
LEXICON = {
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "en": "the of and to in is was that for on with as at by from this are it an a be he or".split(),
    "es": "el la de que y en los se del las por un para con no una su al lo como más es".split(),
    "fr": "le la les de des du et que un une en est dans pour qui pas sur au par avec il elle".split(),
}
CLASSES = ("letter", "upper", "digit", "space", "mark", "symbol", "other")


@dataclass(frozen=True)
class Rules:
    """Thresholds. Distances are judged only from the least lengths on.

    About 0.8 of the words of a reference are no common words, so a text without any lies only 0.32 to
    0.34 from it; word_distance must be below that.
    """

    least_words: int = 50
    most_repeat_percent: int = 50
    least_chars: int = 200
    class_distance: float = 0.27
    word_distance: float = 0.3
    lexicon: dict[str, list[str]] = field(default_factory=lambda: LEXICON)

    @property
    def bins(self) -> list[str]:
        return sorted({w for ws in self.lexicon.values() for w in ws})


def base_columns(classes: Column, ws: Column, lines: Column) -> dict[str, Column]:
    """Counts of the contract but n_repeat_words, from class_counts() and the length n, the words, and the lines that have a word."""
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": (classes["n"] - classes["space"]).cast("long"),
        "n_symbols": classes["n_symbols"].cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def windows(ws: Column) -> Column:
    """A hash of each three-word window. ws must be a column, and is read more than once."""
    at = F.when(F.size(ws) >= 3, F.sequence(F.lit(0), F.size(ws) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))


def repeated_starts(hashes: Column, ranked: Column) -> Column:
    """Sorted starts of the windows found twice or more; ranked: (hash, start) sorted."""
    same = lambda a, b: F.coalesce(F.get(ranked, b)["h"] == a["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(ranked, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))


def covered(starts: Column) -> Column:
    """How many words lie in a window of three that starts at one of the sorted starts."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(s - acc["last"], F.lit(3))).alias("n")),
        lambda acc: acc["n"],
    )


def class_counts(text: Column) -> dict[str, Column]:
    """Characters by class, each counted in what the classes before it have left, and among the symbols those of the contract."""
    cased = F.regexp_replace(text, r"\p{Ll}+", "")
    rest = F.regexp_replace(cased, r"\p{L}+", "")
    plain = F.regexp_replace(rest, SPACE, "")
    undigit = F.regexp_replace(plain, "[0-9]+", "")
    unmarked = F.regexp_replace(undigit, r"""[.,;:!?'"()-]+""", "")
    other = F.regexp_replace(unmarked, "[!-~]+", "")
    n = F.length
    return {
        "letter": n(text) - n(cased),
        "upper": n(cased) - n(rest),
        "digit": n(plain) - n(undigit),
        "space": n(rest) - n(plain),
        "mark": n(undigit) - n(unmarked),
        "symbol": n(unmarked) - n(other),
        "other": n(other),
        "n_symbols": n(F.regexp_replace(unmarked, "[^#*$%&|<>]+", "")),
    }


def ranked_words(ws: Column, bins: list[str]) -> Column:
    """The words that are bins, sorted, with one more of each bin; bins must be sorted."""
    most = max(map(len, bins))
    return F.sort_array(F.concat(F.filter(ws, lambda w: (F.length(w) <= most) & w.isin(bins)), F.split(F.lit(" ".join(bins)), " ")))


def bin_counts(ranked: Column) -> Column:
    """How often each bin is a word, from ranked_words(), which must be a column: the lengths of the runs, less one."""
    starts = F.filter(F.transform(ranked, lambda w, i: F.when((i == 0) | (w != F.get(ranked, i - 1)), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(ranked)))
    return F.zip_with(ends, starts, lambda end, start: (end - start - 1).cast("long"))


def js_distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance, base 2, of two distributions, from 0 to 1."""

    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(p, F.array(*(F.lit(float(x)) for x in q)), lambda x, y: term(x, y) + term(y, x))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2, F.lit(0.0)))


def references(docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> dict[str, tuple[list[int], list[int], int]]:
    """By language of the lexicon: sums of the class counts, of the word counts by bin, and of words, over all documents of at least least_words words."""
    bins = rules.bins
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.where(F.col(lang).isin(list(rules.lexicon))).select(F.col(lang).alias("lang"), t.alias("t"), words(F.col(text)).alias("ws"))
    out = out.where(F.size("ws") >= rules.least_words)
    out = out.select("lang", F.size("ws").alias("n"), ranked_words(F.col("ws"), bins).alias("ranked"), *(c.cast("long").alias(k) for k, c in class_counts(F.col("t")).items()))
    out = out.withColumn("counts", bin_counts(F.col("ranked")))
    rows = out.groupBy("lang").agg(*(F.sum(c).alias(c) for c in CLASSES), *(F.sum(F.get("counts", F.lit(i))).alias(f"b{i}") for i in range(len(bins))), F.sum("n").alias("n")).collect()
    return {r["lang"]: ([r[c] for c in CLASSES], [r[f"b{i}"] for i in range(len(bins))], r["n"]) for r in sorted(rows, key=lambda r: r["lang"])}


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """docs with a struct ``quality`` (or _quality): counts, distances, nearest language, base_failed and kept.

    A null text is empty: no words, so base_failed. Without any reference (no document of a known
    language) distances are 0 and only the base decides. Equal rows get equal verdicts. An empty
    table stays empty.
    """
    refs = references(docs, text, lang, rules)
    bins, column = rules.bins, fresh(docs, "quality")
    name = {k: fresh(docs, f"q_{k}") for k in ("t", "ws", "lines", "h", "ranked", "starts", "words", "counts", "base", "class")}
    col = {k: F.col(v) for k, v in name.items()}
    out = docs.withColumn(name["t"], F.coalesce(F.col(text), F.lit(""))).withColumn(name["ws"], words(F.col(text)))
    lines = F.filter(F.split(col["t"], "\n", -1), lambda x: x.rlike(WORD))
    out = out.withColumns({name["h"]: windows(col["ws"]), name["ranked"]: ranked_words(col["ws"], bins), name["lines"]: lines})
    classes = F.struct(F.length(col["t"]).alias("n"), *(c.alias(k) for k, c in class_counts(col["t"]).items()))
    out = out.withColumn(name["class"], classes)
    pairs = F.sort_array(F.transform(col["h"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Only texts with a repeated window are sorted.
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn(name["starts"], F.when(F.size(F.array_distinct(col["h"])) < F.size(col["h"]), pairs).otherwise(none))
    repeat = F.when(F.size(col["starts"]) == 0, F.lit(0).cast("long")).otherwise(covered(repeated_starts(col["h"], col["starts"])))
    counts = base_columns(col["class"], col["ws"], col["lines"])
    out = out.withColumns(
        {
            name["base"]: F.struct(*(c.alias(k) for k, c in counts.items()), repeat.alias("n_repeat_words")),
            name["counts"]: bin_counts(col["ranked"]),
        }
    )
    base, classes = col["base"], col["class"]
    failed = (base["n_words"] < rules.least_words) | (100 * base["n_repeat_words"] > rules.most_repeat_percent * base["n_words"])
    n_chars, n_words = F.greatest(classes["n"], F.lit(1)), F.greatest(base["n_words"], F.lit(1))
    own_classes = F.array(*(classes[c] / n_chars for c in CLASSES))
    near = []
    for code, (by_class, by_word, total) in refs.items():
        chars = max(1, sum(by_class))
        own = [bins.index(w) for w in rules.lexicon[code]]
        found = F.transform(int_array(own), lambda i: F.get(col["counts"], i))
        rest = n_words - F.aggregate(found, F.lit(0).cast("long"), lambda acc, x: acc + x)
        p = F.transform(F.concat(found, F.array(rest)), lambda x: x / n_words)
        q = [by_word[i] / total for i in own] + [(total - sum(by_word[i] for i in own)) / total]
        near.append(
            F.struct(
                js_distance(own_classes, [c / chars for c in by_class]).alias("class_distance"),
                js_distance(p, q).alias("word_distance"),
                F.lit(code).alias("language"),
            )
        )
    if not near:
        near = [F.struct(F.lit(0.0).alias("class_distance"), F.lit(0.0).alias("word_distance"), F.lit(None).cast("string").alias("language"))]
    scored = F.transform(
        F.array(*near),
        lambda x: F.struct(
            F.greatest(x["class_distance"] / rules.class_distance, x["word_distance"] / rules.word_distance).alias("excess"), x["class_distance"].alias("class_distance"), x["word_distance"].alias("word_distance"), x["language"].alias("language")
        ),
    )
    out = out.withColumn(name["words"], F.array_min(scored))
    best = col["words"]
    diverges = (classes["n"] >= rules.least_chars) & (base["n_words"] >= rules.least_words) & (best["excess"] > 1)
    verdict = F.struct(
        *(base[c].alias(c) for c in (*counts, "n_repeat_words")),
        failed.alias("base_failed"),
        (~failed & ~diverges).alias("kept"),
        best["class_distance"].alias("class_distance"),
        best["word_distance"].alias("word_distance"),
        best["language"].alias("language"),
    )
    return out.withColumn(column, pinned(verdict)).drop(*name.values())
