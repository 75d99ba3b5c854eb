"""Editorial rules on index entries, and the consolidation of entries before rendering.

Entries are rows (id, canonical, variants), their locators rows (id, section_ref, folio), so no entry
has to hold all its places. Rules are a fixture of a few rows (rule, term, target) in order. They
apply class by class in ORDER and one after the other inside a class, each to what the ones before
it have left. Only names that rules mention can change, so the rules are first run on the driver over
the counts of these names; that gives one small table of fates, and one join applies them all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed order in which classes of rules apply.
ORDER = ("R4", "R5", "R6", "R7", "R3", "R8", "R2", "R1", "R9")
#: The most rules of a fixture, which bounds what reaches the driver and the table of fates.
MOST_RULES = 20_000
NBSP = "\u00a0"


@dataclass
class Group:
    """Entries of one name: what becomes of them."""

    first: str
    now: str | None
    n: int
    cleared: bool = False
    into: str | None = None


@dataclass
class Compiled:
    """The fates of the names that rules mention, and what is left to the renderer."""

    groups: list[Group] = field(default_factory=list)
    mismatches: list[tuple[str, str, str]] = field(default_factory=list)
    report: list[tuple[str, str, str]] = field(default_factory=list)
    removed_xrefs: set[str] = field(default_factory=set)
    suppressed_stems: set[str] = field(default_factory=set)
    replacements: list[tuple[str, str]] = field(default_factory=list)


def run_rules(counts: dict[str, int], rules: list[tuple[str, str, str | None]]) -> Compiled:
    """The rules over names and how many entries each has. A rule whose result is there already does nothing."""
    out = Compiled([Group(name, name, n) for name, n in sorted(counts.items())])
    live = lambda name: [g for g in out.groups if g.now == name]

    def one(rule: str, term: str, target: str | None) -> str:
        if rule == "R5":
            out.removed_xrefs.add(term)
            return "deferred"
        if rule == "R6":
            out.suppressed_stems.add(term)
            return "deferred"
        if rule == "R9":
            out.replacements.append((term, target or ""))
            return "deferred"
        own, there = live(term), live(target) if target is not None else []
        if rule == "R4":
            for g in own:
                g.now = None
        elif rule == "R7":
            if not there:
                return "no_match"
            for g in own:
                g.now, g.into = None, there[0].first
        elif rule == "R2":
            if there:
                return "unchanged"
            own = [g for g in out.groups if g.now is not None and g.now.lower() == term.lower()]
            for g in own:
                g.now = target
        elif rule == "R1":
            if own and all(g.cleared for g in own):
                return "unchanged"
            for g in own:
                g.cleared = True
        else:
            if rule == "R3" and sum(g.n for g in own) > 1:
                return "ambiguous"
            for g in own:
                g.now = target
        return "applied" if own else "unchanged" if there else "no_match"

    for kind in ORDER:
        for rule, term, target in rules:
            if rule == kind:
                status = one(rule, term, target)
                out.report.append((rule, term, status))
                if status in ("no_match", "ambiguous"):
                    missing = target if rule == "R7" and not live(target) else term
                    out.mismatches.append((rule, missing, status))
    return out


def compile_rules(entries: DataFrame, rules: DataFrame) -> Compiled:
    """run_rules over the entries whose name, in any case, a rule mentions."""
    given = [(r["rule"], r["term"], r["target"]) for r in rules.select("rule", "term", "target").limit(MOST_RULES + 1).collect()]
    if len(given) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    names = sorted({n.lower() for _, *ns in given for n in ns if n is not None})
    mentioned = entries.sparkSession.createDataFrame([(n,) for n in names], "low string")
    rows = entries.select("canonical", F.lower("canonical").alias("low")).join(F.broadcast(mentioned), "low", "left_semi").groupBy("canonical").agg(F.count("*").alias("n")).collect()
    return run_rules({r["canonical"]: r["n"] for r in rows}, given)


def apply_compiled(entries: DataFrame, locators: DataFrame, done: Compiled) -> tuple[DataFrame, DataFrame]:
    """(entries, locators) after the rules. Folded locators go to the first entry, by id, of their target; equal ones count once."""
    spark = entries.sparkSession
    fates = F.broadcast(spark.createDataFrame([(g.first, g.now, g.cleared, g.into) for g in done.groups], "first string, now string, cleared boolean, into string"))
    marked = entries.join(fates, F.col("canonical") == F.col("first"), "left")
    known = F.col("first").isNotNull()
    none = F.array().cast("array<string>")
    kept = marked.where(~known | F.col("now").isNotNull()).select("id", F.when(known, F.col("now")).otherwise(F.col("canonical")).alias("canonical"), F.when(F.col("cleared"), none).otherwise(F.col("variants")).alias("variants"))
    folded = marked.where("into IS NOT NULL").select("id", "into")
    targets = marked.where(known).groupBy("canonical").agg(F.min("id").alias("to")).select(F.col("canonical").alias("into"), "to")
    moves = folded.join(targets, "into").select("id", "to")
    gone = marked.where(known & F.col("now").isNull()).select("id")
    placed = locators.join(gone, "id", "left_anti").select("id", "section_ref", "folio").union(locators.join(moves, "id").select(F.col("to").alias("id"), "section_ref", "folio"))
    return kept, placed.distinct()


def apply_rules(entries: DataFrame, locators: DataFrame, rules: DataFrame, allow_stale: bool = False) -> tuple[DataFrame, DataFrame, Compiled]:
    """(entries, locators, what was done). Rules that fit nothing, or several entries where one is meant, abort unless allow_stale."""
    done = compile_rules(entries, rules)
    if done.mismatches and not allow_stale:
        raise ValueError(f"rules that do not fit: {done.mismatches}")
    return *apply_compiled(entries, locators, done), done


def suggestions(terms: DataFrame, entries: DataFrame, top: int = 3, cutoff: float = 0.6) -> DataFrame:
    """(term, rank, canonical): the names most like each unmatched term, by matching blocks, ties by falling name; terms (term) are few.

    Each partition keeps the best of its names, so top rows for each term and partition are shuffled.
    """
    wanted = [r["term"] for r in terms.select("term").distinct().limit(MOST_RULES).collect()]

    def best(batches):
        import difflib
        import heapq

        import pandas as pd

        held = {t: [] for t in wanted}
        for batch in batches:
            for name in batch["canonical"].dropna():
                for t in wanted:
                    m = difflib.SequenceMatcher(None, name, t)
                    if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff and (score := m.ratio()) >= cutoff:
                        held[t] = heapq.nlargest(top, [*held[t], (score, name)])
        yield pd.DataFrame([(t, s, n) for t, rows in held.items() for s, n in rows], columns=["term", "score", "canonical"])

    rows = entries.select("canonical").distinct().mapInPandas(best, "term string, score double, canonical string")
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.col("score").desc(), F.col("canonical").desc()))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("term", "rank", "canonical")


def filter_variants(entries: DataFrame, keep: int = 3) -> DataFrame:
    """Variants that are shown: not the canonical in other case, no cruft, no plain plural; one for each spelling in lower case; the longest first, three at most."""
    from foliant.functions import text as T

    rows = entries.select("id", "canonical", F.posexplode("variants").alias("at", "variant"))
    v, c = F.lower("variant"), F.lower("canonical")
    rows = rows.where((v != c) & ~T.is_cruft(F.col("variant")) & (T.plural(c) != v) & (T.plural(v) != c))
    first = F.row_number().over(Window.partitionBy("id", v).orderBy("at"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.length("variant").desc(), "variant"))
    shown = rows.withColumn("n", first).where("n = 1").withColumn("rank", rank).where(F.col("rank") <= keep)
    return shown.select("id", "rank", "variant")


def plural_pairs(entries: DataFrame, protected: list[str]) -> DataFrame:
    """(singular, plural): neighbours in sort order of which one is the other's plural, with the same locators and neither protected.

    Only neighbours can pair. A run of pairs that overlap is settled from its start, every second one.
    """
    from foliant.functions import text as T

    order = Window.partitionBy("letter").orderBy("key", "id")
    rows = entries.withColumn("key", F.lower("canonical")).withColumn("letter", F.left("key", F.lit(1)))
    rows = rows.withColumn("next", F.lead(F.struct("canonical", "key", "locators")).over(order)).withColumn("at", F.row_number().over(order))
    fits = (T.plural(F.col("key")) == F.col("next.key")) & (F.col("locators") == F.col("next.locators")) & ~F.col("key").isin(protected) & ~F.col("next.key").isin(protected)
    pairs = rows.where(fits)
    run = F.col("at") - F.row_number().over(Window.partitionBy("letter").orderBy("at"))
    place = F.row_number().over(Window.partitionBy("letter", "run").orderBy("at"))
    return pairs.withColumn("run", run).withColumn("place", place).where("place % 2 = 1").select(F.col("canonical").alias("singular"), F.col("next.canonical").alias("plural"))


def parent_dedup(children: DataFrame, entries: DataFrame) -> DataFrame:
    """(stem, canonical): entries that stand alone and also below a synthetic stem with which they begin, with equal sets of locators; children (stem, canonical, locators)."""
    a = children.select("stem", "canonical", F.array_sort(F.array_distinct("locators")).alias("la"))
    b = entries.select("canonical", F.array_sort(F.array_distinct("locators")).alias("lb"))
    return a.join(b, "canonical").where((F.col("la") == F.col("lb")) & (F.lower(F.substring_index("canonical", " ", 1)) == F.col("stem"))).select("stem", "canonical")


def locator_text(section_ref: Column, folio: Column) -> Column:
    return F.concat(F.lit(f"§{NBSP}"), section_ref, F.lit(f" (p.{NBSP}"), folio, F.lit(")"))
