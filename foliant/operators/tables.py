"""Tables of cases, statutes and rules: grouping, subsections, short forms and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import citations as C
from foliant.functions import text as T


def hits(pages: DataFrame) -> DataFrame:
    """(page, chapter, kind, system, number, path, surface, start) of all citations; pages (page, chapter, text)."""
    return pages.select("page", "chapter", F.explode(C.citations(F.col("text"))).alias("c")).select("page", "chapter", "c.kind", "c.system", "c.number", "c.path", "c.surface", "c.start")


def rules_table(found: DataFrame) -> DataFrame:
    """(system, number, path, pages, n, key): a row for each rule and, with its path, for each subsection."""
    rules = found.where(F.col("kind").isin([p.kind for p in C.RULES]))
    grouped = rules.groupBy("system", F.col("number").cast("int").alias("number"), "path").agg(F.array_join(F.array_sort(F.collect_set("page")), ",").alias("pages"), F.count("*").alias("n"))
    return grouped.withColumn("key", F.concat(F.col("system"), F.lit(" "), F.lpad(F.col("number").cast("string"), 4, "0"), F.col("path")))


def attach_subsections(evidence: DataFrame, found: DataFrame) -> DataFrame:
    """Evidence of rules (page, system, number) with the subsection path of its page if exactly one is cited there, else empty."""
    one = found.where("path <> ''").groupBy("page", "system", "number").agg(F.collect_set("path").alias("p")).where(F.size("p") == 1).select("page", "system", "number", F.get("p", F.lit(0)).alias("path"))
    return evidence.join(one, ["page", "system", "number"], "left").withColumn("path", F.coalesce("path", F.lit("")))


def cases_table(found: DataFrame) -> DataFrame:
    """(name, cite, first_page, first_start, n, sort_key): cases by name, with the data of their first citation."""
    cases = found.where("kind = 'CASE'")
    grouped = cases.groupBy(F.col("number").alias("name")).agg(F.min(F.struct("chapter", "page", "start", F.col("path").alias("cite"))).alias("x"), F.count("*").alias("n"))
    return grouped.select("name", "x.cite", F.col("x.page").alias("first_page"), F.col("x.start").alias("first_start"), "n", F.lower(T.case_sort_key(F.col("name"))).alias("sort_key"))


def merge_spaced(statutes: DataFrame) -> DataFrame:
    """Statutes (ordinal, canonical, page) that differ by white space only, as one, in order of first sight."""
    norm = F.trim(F.regexp_replace("canonical", r"\s+", " "))
    return statutes.groupBy(norm.alias("canonical")).agg(F.min("ordinal").alias("ordinal"), F.array_join(F.array_sort(F.collect_set("page")), ",").alias("pages"))


def short_forms(cites: DataFrame) -> DataFrame:
    """Short citations with the full one before them in their chapter; cites (chapter, place, is_full, name). Without one they are orphans (null)."""
    before = Window.partitionBy("chapter").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return cites.withColumn("antecedent", F.last(F.when(F.col("is_full"), F.col("name")), ignorenulls=True).over(before)).where(~F.col("is_full")).select("chapter", "place", "name", "antecedent")


def counters(found: DataFrame) -> DataFrame:
    return found.groupBy("kind", "system").agg(F.count("*").alias("n"))


def bridged(found: DataFrame, spellings: DataFrame) -> DataFrame:
    """(name, pdf_page, start): where a citation is found in any of its spellings, a place once; found has hits (term, pdf_page, start), spellings (name, spelling)."""
    return found.join(spellings, F.col("term") == F.col("spelling")).select("name", "pdf_page", "start").distinct()


def parent_rule(names: DataFrame) -> DataFrame:
    """Names of rules that may be verified: a subsection in brackets is an error, as tokens do not hold it."""
    return names.select("name", F.when(F.contains("name", F.lit("(")), F.raise_error(F.concat(F.lit("not a bare rule: "), F.col("name")))).otherwise(F.trim("name")).alias("term"))


def derived(surfaces: DataFrame) -> DataFrame:
    """(bucket) of surfaces (bucket, surface) where one names a case and another, of several words, holds the last word of its first party."""
    is_case = F.col("surface").rlike(r"[A-Za-z.'-]+\s+v\.\s+[A-Za-z]")
    words = F.split(F.lower("surface"), r"\s+")
    party = F.lower(F.element_at(F.split(F.trim(F.substring_index("surface", " v.", 1)), r"\s+"), -1))
    rows = surfaces.select("bucket", is_case.alias("case"), party.alias("party"), words.alias("words"))
    parties = rows.where("case").select("bucket", "party").distinct()
    # Joined on the word, so buckets of many surfaces do not pair all of them.
    others = rows.where(~F.col("case") & (F.size("words") > 1)).select("bucket", F.explode(F.array_distinct("words")).alias("party"))
    return others.join(parties, ["bucket", "party"], "left_semi").select("bucket").distinct()
