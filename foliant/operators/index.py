"""Assembly of an index: elections, citation rules, ranges, cross-references and subdivision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

SHARED_REFS, TOP_SEE_ALSO = 3, 5
#: Letters by which keys are grouped for running ids.
LETTERS = 3


def elect_canonical(surfaces: DataFrame) -> DataFrame:
    """(bucket, canonical): spelled out over acronym, then longest without article, then first seen, then text; surfaces (bucket, surface, first_seen)."""
    order = Window.partitionBy("bucket").orderBy(T.is_acronym(F.col("surface")), F.length(T.strip_article(F.col("surface"))).desc(), F.col("first_seen").asc_nulls_last(), "surface")
    return surfaces.withColumn("n", F.row_number().over(order)).where("n = 1").select("bucket", F.col("surface").alias("canonical"))


def common_path(paths: Column) -> Column:
    """The longest common prefix of paths: the least and the greatest decide, whatever lies between."""
    low, high = F.array_min(paths), F.array_max(paths)
    n = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(low), F.size(high)), F.lit(1))), lambda i: F.slice(low, F.lit(1), i) == F.slice(high, F.lit(1), i)))
    return F.slice(low, F.lit(1), n)


def chapter_citations(rows: DataFrame) -> DataFrame:
    """Evidence clustered by term and chapter: the lowest common section of all paths, and the first row as representative."""
    chapter = F.substring_index(F.get("section_path", F.lit(0)), ".", 1)
    out = rows.withColumn("chapter", chapter).groupBy("canonical_term", "chapter").agg(F.min("section_path").alias("low"), F.max("section_path").alias("high"), F.min(F.struct("pdf_page", "token_offset", "folio")).alias("first"), F.count("*").alias("n_hits"))
    path = common_path(F.array("low", "high"))
    return out.select("canonical_term", "chapter", F.coalesce(F.element_at(path, F.when(F.size(path) > 0, -1)), F.col("chapter")).alias("section_ref"), F.col("first.folio").alias("folio"), F.col("first.pdf_page").alias("pdf_page"), "n_hits")


def evidence_ids(rows: DataFrame, key: str) -> DataFrame:
    """A running id from 1 in order of key, section and folio.

    Ids are global: counts are summed by key, then by the first letters of keys, so that no window
    holds more than the keys of a few letters, and sums are added to ranks inside keys.
    """
    inside = F.row_number().over(Window.partitionBy(key).orderBy("section_ref", "folio"))
    head = F.coalesce(F.left(F.col(key), F.lit(LETTERS)), F.lit("")).alias("head")
    keys = rows.groupBy(key).agg(F.count("*").alias("k")).select(key, head, "k")
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    heads = keys.groupBy("head").agg(F.sum("k").alias("k")).select("head", F.coalesce(F.sum("k").over(upto().orderBy("head")), F.lit(0)).alias("b0"))
    before = keys.withColumn("b1", F.coalesce(F.sum("k").over(upto("head").orderBy(key)), F.lit(0))).join(heads, "head").select(key, (F.col("b0") + F.col("b1")).alias("before"))
    return rows.withColumn("rank", inside).join(before, key).withColumn("evidence_id", F.col("before") + F.col("rank")).drop("rank", "before")


def folio_runs(locators: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., section_ref, lo, hi, folio): runs of consecutive arabic folios of a section; other folios stand alone. locators (keys..., section_ref, folio)."""
    number = F.when(F.col("folio").rlike("^[0-9]+$"), F.col("folio").try_cast("int"))
    by = Window.partitionBy(*keys, "section_ref").orderBy(F.col("number").asc_nulls_last(), "folio")
    starts = F.when(F.coalesce(F.lag("number").over(by) + 1 == F.col("number"), F.lit(False)), 0).otherwise(1)
    runs = locators.withColumn("number", number).withColumn("starts", starts).withColumn("run", F.sum("starts").over(by))
    return runs.groupBy(*keys, "section_ref", "run").agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.min("folio").alias("folio"))


def folio_ranges(locators: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., section_ref, first_folio, label) of the runs of folio_runs."""
    out = folio_runs(locators, keys)
    label = F.when(F.col("lo").isNull() | (F.col("lo") == F.col("hi")), F.concat(F.lit("p.\u00a0"), F.col("folio"))).otherwise(F.concat(F.lit("pp.\u00a0"), F.col("lo").cast("string"), F.lit("–"), F.col("hi").cast("string")))
    return out.select(*keys, "section_ref", F.coalesce("lo", F.lit(-1)).alias("first_folio"), label.alias("label"))


def section_ranges(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of sections of one depth and prefix whose last numbers follow each other; chapters never merge. refs (keys..., section_ref)."""
    parts = F.split("section_ref", r"\.")
    n = F.size(parts)
    rows = refs.distinct().select(*keys, "section_ref", n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n - 1), ".").alias("prefix"), F.element_at(parts, -1).cast("int").alias("last"))
    by = Window.partitionBy(*keys, "depth", "prefix").orderBy("last", "section_ref")
    starts = F.when((F.col("depth") > 1) & F.coalesce(F.lag("last").over(by) + 1 == F.col("last"), F.lit(False)), 0).otherwise(1)
    runs = rows.withColumn("starts", starts).withColumn("run", F.sum("starts").over(by))
    out = runs.groupBy(*keys, "depth", "prefix", "run").agg(F.min_by("section_ref", "last").alias("lo"), F.max_by("section_ref", "last").alias("hi"))
    return out.select(*keys, "depth", "lo", "hi", F.when(F.col("lo") == F.col("hi"), F.concat(F.lit("§"), F.col("lo"))).otherwise(F.concat(F.lit("§§"), F.col("lo"), F.lit("–"), F.col("hi"))).alias("label"))


def shared_sections(entries: DataFrame, least: int = SHARED_REFS) -> DataFrame:
    """(a, b, shared): pairs of entries with least or more sections in common; entries (entry, section_ref)."""
    refs = entries.select("entry", "section_ref").distinct()
    a, b = refs.select(F.col("entry").alias("a"), "section_ref"), refs.select(F.col("entry").alias("b"), "section_ref")
    return a.join(b, "section_ref").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def see_also(entries: DataFrame, top: int = TOP_SEE_ALSO) -> DataFrame:
    """(entry, target, shared): the top partners of each entry by sections shared, ties by name, both ways."""
    pairs = shared_sections(entries)
    both = pairs.select(F.col("a").alias("entry"), F.col("b").alias("target"), "shared").union(pairs.select("b", "a", "shared"))
    rank = F.row_number().over(Window.partitionBy("entry").orderBy(F.col("shared").desc(), "target"))
    return both.withColumn("n", rank).where(F.col("n") <= top).drop("n")


def unique_slugs(entries: DataFrame) -> DataFrame:
    """(canonical, slug): in order of the lower-case name an entry takes its slug, or with -2, -3 and so on the first that is free.

    Only slugs that are equal up to numbers at their end can meet, so entries are dealt by that root,
    and the names of a root are settled in one pass.
    """
    slugged = entries.select("canonical", T.slugify(F.col("canonical")).alias("base")).withColumn("root", F.regexp_replace("base", "(-[0-9]+)+$", ""))
    alone = F.count("*").over(Window.partitionBy("root")) == 1
    marked = slugged.withColumn("alone", alone)

    def settle(rows):
        import pandas as pd

        taken, least, out = set(), {}, []
        for base in rows.sort_values(["low", "canonical"])["base"]:
            slug = base
            if slug in taken:
                n = least.get(base, 2)
                while f"{base}-{n}" in taken:
                    n += 1
                least[base], slug = n, f"{base}-{n}"
            taken.add(slug)
            out.append(slug)
        return pd.DataFrame({"canonical": rows.sort_values(["low", "canonical"])["canonical"].to_numpy(), "slug": out})

    met = marked.where("NOT alone").select("root", "canonical", "base", F.lower("canonical").alias("low")).groupBy("root").applyInPandas(settle, "canonical string, slug string")
    return marked.where("alone").select("canonical", F.col("base").alias("slug")).union(met)


def synthetic_stems(canonicals: DataFrame, least: int = 3) -> DataFrame:
    """(stem, n, first_member): lemmas of at least four letters that least or more canonicals share."""
    return stem_members(canonicals).groupBy("stem").agg(F.count("*").alias("n"), F.min("canonical").alias("first_member")).where(F.col("n") >= least)


def stem_members(canonicals: DataFrame) -> DataFrame:
    """(stem, canonical): the lemmas of at least four letters of each canonical."""
    words = canonicals.select("canonical", F.explode(F.array_distinct(F.transform(F.split(F.lower("canonical"), " "), T.lemma))).alias("stem"))
    return words.where(F.col("stem").rlike("^[a-z]{4,}$")).select("stem", "canonical")


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed."""
    joined = old.select(F.col(key), F.col(value).alias("before"), F.lit(1).alias("o")).join(new.select(F.col(key), F.col(value).alias("after"), F.lit(1).alias("n")), key, "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return joined.select(key, change.alias("change")).where(F.col("change").isNotNull())
