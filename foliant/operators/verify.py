"""Phrase verification: every occurrence of many phrases in one plan.

A phrase matches at a position exactly, by lemma, or as one of its variants; at each start the
first of these counts. Each phrase is anchored at its longest word, which stands for its rarest: no
pass over the corpus is needed to find it. Tokens are exploded once and joined once, by lemma, which
every mode shares. A frequent anchor leaves many candidates for each page, so they are told beside the
tokens of their page, inside the scan: only matches are written. Phrases too many to broadcast meet the
tokens by a shuffle, and their candidates the page by another. Each alternative carries those that come
before it, so that the first at a start is told there too, without a window over all matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

SNIPPET_WINDOWS, SNIPPET_CHARS = (30, 50), 60
BROADCAST_ROWS = 200_000
#: A term may have so many alternatives before one for these to be told beside the page; beyond that, by a window.
EARLIER_FORMS = 8


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def alternatives(terms: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """(term, rank, words): the words of the term with rank 0, then variants in their order; terms (term), variants (term, variant, ordinal).

    Terms without a word are dropped.
    """
    out = terms.select("term", F.lit(0).alias("rank"), tokenize(F.col("term")).alias("words"))
    if variants is not None:
        out = out.union(variants.select("term", (F.col("ordinal") + 1).cast("int"), tokenize(F.col("variant"))))
    return out.where(F.size("words") > 0)


def hits(pages: DataFrame, terms: DataFrame, variants: DataFrame | None = None, texts: bool = False) -> DataFrame:
    """(term, pdf_page, start, stop, mode): all matches, overlapping ones too; stop is the last position.

    pages (pdf_page, texts, norms). Windows never cross pages and run over body tokens only. A null
    page has no match. With texts, also the matched text and the snippet.
    """
    alts = alternatives(terms, variants)
    earlier = None
    if variants is not None:
        alts = alts.distinct()
        earlier = (alts.groupBy("term").count().agg(F.max("count")).first()[0] or 1) - 1
    few = alts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    page = ["norms", "lemmas", *(["texts"] if texts else [])]
    rows = pages.withColumn("norms", T.pinned(F.col("norms")))
    rows = rows.withColumn("lemmas", T.pinned(F.transform("norms", T.lemma))).select("pdf_page", *page)
    tokens = rows.select("pdf_page", *(page if few else []), F.posexplode("lemmas").alias("pos", "lemma"))
    place = F.array_position(F.transform("words", F.length), F.array_max(F.transform("words", F.length))) - 1
    anchored = alts.withColumn("place", place.cast("int")).withColumn("stems", F.transform("words", T.lemma))
    anchored = anchored.withColumn("anchor", F.get("stems", F.col("place"))).withColumn("first", F.get("stems", F.lit(0))).withColumn("last", F.element_at("stems", -1))
    if earlier is not None and earlier <= EARLIER_FORMS:
        anchored = _with_earlier(anchored)
    met = tokens.join(F.broadcast(anchored) if few else anchored, F.col("lemma") == F.col("anchor"))
    both = met.withColumn("start", F.col("pos") - F.col("place")).where("start >= 0")
    if not few:
        both = both.select("pdf_page", "start", "term", "rank", "words", "stems", "first", "last", *[c for c in anchored.columns if c == "forms"]).join(rows, "pdf_page")
    # No lambda stands here, so that candidates of a broadcast are told in generated code, without a copy of their page.
    # Catalyst orders filters as it likes, so a start before the page must not fail.
    at = F.greatest("start", F.lit(0))
    here = lambda c: F.slice(c, at + 1, F.size("words"))
    same = here("norms") == F.col("words")
    ends = (F.get("lemmas", at) == F.col("first")) & (F.get("lemmas", at + F.size("words") - 1) == F.col("last"))
    both = both.where(F.when(~F.coalesce(ends, F.lit(False)), False).when(F.col("rank") > 0, same).otherwise(here("lemmas") == F.col("stems")))
    if "forms" in anchored.columns:
        both = both.where(~_taken(at, earlier))
    mode = F.when(F.col("rank") > 0, "variant").when(same, "exact").otherwise("lemma")
    stop = F.col("start") + F.size("words") - 1
    more = [F.array_join(here("texts"), " ").alias("matched"), snippet(F.col("texts"), at).alias("snippet")] if texts else []
    found = both.select("term", "pdf_page", "start", stop.alias("stop"), mode.alias("mode"), "rank", *more)
    if variants is not None and "forms" not in anchored.columns:
        # By page and not by start, so that counts by page need no other shuffle.
        before = F.lag("start").over(Window.partitionBy("term", "pdf_page").orderBy("start", "rank"))
        found = found.withColumn("before", before).where("before IS NULL OR before <> start").drop("before")
    return found.drop("rank")


def _with_earlier(anchored: DataFrame) -> DataFrame:
    """Each alternative with forms, those of its term that come before it by rank and words."""
    every = anchored.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("rank", "words", "stems"))).alias("forms"))
    before = F.array_position("forms", F.struct("rank", "words", "stems")).cast("int") - 1
    return anchored.join(every, "term").withColumn("forms", F.slice("forms", F.lit(1), before))


def _taken(at: Column, most: int) -> Column:
    """Whether one of the forms, most of them at most, matches at the same place; spelled out, as a lambda would leave generated code."""
    out = F.lit(False)
    for i in range(most):
        form = F.get("forms", F.lit(i))
        here = lambda c: F.slice(c, at + 1, F.size(form["words"]))  # noqa: B023, E731
        same = F.when(form["rank"] > 0, here("norms") == form["words"]).otherwise(here("lemmas") == form["stems"])
        out = out | F.when(F.size("forms") > i, F.coalesce(same, F.lit(False))).otherwise(False)
    return out


def snippet(texts: Column, at: Column) -> Column:
    """The tokens around a place, wider if that is short; null if even that is too short."""
    around = lambda n: F.array_join(F.slice(texts, F.greatest(at - n, F.lit(0)) + 1, F.least(at, F.lit(n)) + n + 1), " ")
    near, far = (around(n) for n in SNIPPET_WINDOWS)
    return F.when(F.length(near) >= SNIPPET_CHARS, near).when(F.length(far) >= SNIPPET_CHARS, far)


def evidence(found: DataFrame, placed: DataFrame, folios: DataFrame, others: bool = False) -> DataFrame:
    """Evidence rows of hits with texts; hits outside sections below a chapter are left out, and so are those without a snippet.

    placed (pdf_page, section_ref, level, section_path), folios (pdf_page, folio). With others, hits that
    are left out stay as rows without a section or a snippet.
    """
    how = "left" if others else "inner"
    out = (found if others else found.where("snippet IS NOT NULL")).join(placed.where("level > 0"), "pdf_page", how).join(folios.select("pdf_page", "folio"), "pdf_page", how)
    return out.select(
        F.col("term").alias("canonical_term"),
        F.col("matched").alias("matched_variant"),
        "section_ref",
        F.col("level").alias("section_level"),
        "section_path",
        F.coalesce("folio", F.lit("")).alias("folio"),
        "pdf_page",
        F.col("start").alias("token_offset"),
        F.col("mode").alias("match_mode"),
        F.col("snippet").alias("verbatim_snippet"),
    )


def sweep(rows: DataFrame) -> DataFrame:
    """One row for each term, section and folio: the first by page and place."""
    first = F.row_number().over(Window.partitionBy("canonical_term", "section_ref", "folio").orderBy("pdf_page", "token_offset"))
    return rows.withColumn("n", first).where("n = 1").drop("n")
