"""The positional corpus: pages, sections and tokens as DataFrames, from a table of documents.

A page is a document, its chapter the number in its source plus one, and its folio its rank among
the pages of the chapter that are not blank. Sections are intervals of pages inside a chapter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.session import table

BLANK_CHARS, FOOTNOTE_CHARS, SECTION_PAGES, SUBSECTION_PAGES = 50, 40, 10, 5
#: Windows run inside runs of so many page numbers of a chapter; what comes before is carried in.
RUN_PAGES = 4096


def run_of(page: Column) -> Column:
    return F.floor(page / RUN_PAGES)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chapter, pdf_page, ordinal, folio, folio_style, region, n_chars).

    Pages are counted for each run of a chapter first, so no task sorts a whole chapter.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    chapter = (F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0)) + 1).alias("chapter")
    full = F.col("n_chars") >= BLANK_CHARS
    base = docs.select(chapter, F.col("doc_id").alias("pdf_page"), "n_chars", F.when(full, 1).otherwise(0).alias("full"), run_of(F.col("doc_id")).alias("run"))
    earlier = Window.partitionBy("chapter").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = base.groupBy("chapter", "run").agg(F.count("*").alias("n"), F.sum("full").alias("f"))
    before = runs.select("chapter", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.coalesce(F.sum("f").over(earlier), F.lit(0)).alias("f"))
    by = Window.partitionBy("chapter", "run").orderBy("pdf_page")
    placed = base.withColumn("at", F.row_number().over(by)).withColumn("rank", F.sum("full").over(by)).join(before, ["chapter", "run"])
    numbered = F.col("full") == 1
    return placed.select(
        "chapter",
        "pdf_page",
        (F.col("n") + F.col("at")).cast("int").alias("ordinal"),
        F.when(numbered, (F.col("f") + F.col("rank")).cast("string")).alias("folio"),
        F.when(numbered, "arabic").alias("folio_style"),
        "n_chars",
    )


def two_digits(number: Column) -> Column:
    """A number with at least two digits."""
    text = number.cast("string")
    return F.when(F.length(text) < 2, F.concat(F.lit("0"), text)).otherwise(text)


def section_starts(page: DataFrame) -> DataFrame:
    """(chapter, level, section_ref, start_page, seq): a chapter, its sections, their subsections; seq counts those of a level in the chapter."""
    o = F.col("ordinal") - 1
    level0 = page.where("ordinal = 1").select("chapter", F.lit(0).alias("level"), F.col("chapter").cast("string").alias("section_ref"), F.col("pdf_page").alias("start_page"), F.lit(0).cast("long").alias("seq"))
    major = F.concat_ws(".", F.col("chapter").cast("string"), two_digits(F.floor(o / SECTION_PAGES) + 1))
    level1 = page.where(o % SECTION_PAGES == 0).select("chapter", F.lit(1), major, "pdf_page", F.floor(o / SECTION_PAGES))
    minor = F.concat_ws(".", major, (F.floor((o % SECTION_PAGES) / SUBSECTION_PAGES) + 1).cast("string"))
    level2 = page.where(o % SUBSECTION_PAGES == 0).select("chapter", F.lit(2), minor, "pdf_page", F.floor(o / SUBSECTION_PAGES))
    return level0.union(level1).union(level2)


def sections(page: DataFrame) -> DataFrame:
    """Section intervals: the end is the next start of the level in the chapter, inclusive, or the last page; with the path from the top."""
    starts = section_starts(page)
    last = page.groupBy("chapter").agg(F.max("pdf_page").alias("last_page"))
    following = starts.select("chapter", "level", (F.col("seq") - 1).alias("seq"), F.col("start_page").alias("next_start"))
    out = starts.join(following, ["chapter", "level", "seq"], "left").join(last, "chapter")
    major = F.substring_index("section_ref", ".", 2)
    path = F.when(F.col("level") == 1, F.array("section_ref")).when(F.col("level") == 2, F.array(major, F.col("section_ref"))).otherwise(F.array().cast("array<string>"))
    return out.select("chapter", "level", "section_ref", F.concat(F.lit("ch"), F.col("chapter").cast("string"), F.lit(":"), F.col("section_ref")).alias("global_id"), "start_page", F.coalesce("next_start", "last_page").alias("end_page"), path.alias("section_path"))


def page_sections(page: DataFrame) -> DataFrame:
    """(pdf_page, section_ref, level, section_path): the deepest section that holds each page, the latest start of its level.

    An as-of join: starts and pages are merged in order inside runs of a chapter, and the last start
    before a page is carried forward, from run to run as one row for each. No interval is compared
    with a page that it does not precede.
    """
    starts = section_starts(page)
    events = starts.select("chapter", F.col("start_page").alias("at"), F.lit(0).alias("kind"), "level", "section_ref").union(page.select("chapter", "pdf_page", F.lit(1), F.lit(None).cast("int"), F.lit(None).cast("string")))
    events = events.withColumn("run", run_of(F.col("at")))
    of = lambda n, c: F.when(F.col("level") == n, F.col(c))
    runs = events.groupBy("chapter", "run").agg(*(F.max_by(of(n, "section_ref"), of(n, "at")).alias(f"r{n}") for n in range(3)))
    earlier = Window.partitionBy("chapter").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("chapter", "run", *(F.last(f"r{n}", ignorenulls=True).over(earlier).alias(f"b{n}") for n in range(3)))
    by = Window.partitionBy("chapter", "run").orderBy("at", "kind", "level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = [F.last(of(n, "section_ref"), ignorenulls=True).over(by).alias(f"w{n}") for n in range(3)]
    out = events.select("chapter", "run", "kind", "at", *held).where("kind = 1").join(before, ["chapter", "run"])
    out = out.select("at", *(F.coalesce(f"w{n}", f"b{n}").alias(f"l{n}") for n in range(3)))
    ref, level = F.coalesce("l2", "l1", "l0"), F.when(F.col("l2").isNotNull(), 2).when(F.col("l1").isNotNull(), 1).otherwise(0)
    major = F.substring_index(ref, ".", 2)
    path = F.when(level == 1, F.array(ref)).when(level == 2, F.array(major, ref)).otherwise(F.array().cast("array<string>"))
    return out.select(F.col("at").alias("pdf_page"), ref.alias("section_ref"), level.alias("level"), path.alias("section_path"))


def token_rows(text: Column) -> Column:
    """array<struct<token_index, text, norm, lemma, body>> of a page; a short last line of several is a footnote."""
    word = lambda s: F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}]+"), 0)
    last = F.substring_index(text, "\n", -1)
    is_note = F.contains(text, F.lit("\n")) & (F.length(last) < FOOTNOTE_CHARS)
    body = F.when(is_note, F.substr(text, F.lit(1), F.length(text) - F.length(last))).otherwise(text)
    note = F.when(is_note, word(last)).otherwise(F.array().cast("array<string>"))
    each = lambda ws, flag: F.transform(ws, lambda w: F.struct(w.alias("text"), F.lit(flag).alias("body")))
    return F.concat(each(word(body), True), each(note, False))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pdf_page, token_index, text, norm, lemma, block_type): no shuffle, a page is split in its row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select(F.col("doc_id").alias("pdf_page"), T.pinned(token_rows(F.col("text"))).alias("rows"))
    flat = rows.select("pdf_page", F.posexplode("rows").alias("token_index", "t"))
    norm = F.lower("t.text")
    return flat.select("pdf_page", "token_index", F.col("t.text").alias("text"), norm.alias("norm"), T.lemma(norm).alias("lemma"), F.when(F.col("t.body"), "body").otherwise("footnote").alias("block_type"))


def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pdf_page, texts, norms, lemmas, body_index): a page's tokens as arrays; norms and lemmas of body tokens only.

    Positions in norms are window positions; body_index gives their token_index.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pdf_page"), token_rows(F.col("text")).alias("t"))
    body = F.filter("t", lambda x: x["body"])
    # Body tokens come first on a page, so a body position is its token index.
    return docs.select("pdf_page", F.transform("t", lambda x: x["text"]).alias("texts"), F.transform(body, lambda x: F.lower(x["text"])).alias("norms"))
