"""Headings and their titles, from the spans of page lines.

Spans are rows (pdf_page, block, line, span, is_text, text, font, size). A page is gathered once, in
one shuffle, and each of its headings reads the lines that follow it with array functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.05


@dataclass(frozen=True)
class Style:
    """How the headings of a level look: font and size of the mark, its pattern, the sizes of what goes on, and over how many more blocks."""

    level: int
    font: str
    size: float
    pattern: str
    sizes: tuple[float, ...]
    more_blocks: int
    #: The mark's line holds the start of the title.
    inline: bool
    #: A line that starts like this is another heading.
    stop: str | None


def _near(size: Column, wanted: float) -> Column:
    return F.abs(F.round(size, 2) - F.lit(wanted)) < TOLERANCE


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _text(line: Column) -> Column:
    return _strip(F.array_join(F.transform(line["spans"], lambda s: F.coalesce(s["text"], F.lit(""))), ""))


def is_mark(line: Column, style: Style) -> Column:
    """A span of the line has the font, size and, if the title is on its line, the pattern; otherwise the whole line has the pattern."""
    looks = lambda s: F.coalesce((s["font"] == style.font) & _near(s["size"], style.size), F.lit(False))
    if style.inline:
        return F.exists(line["spans"], lambda s: looks(s) & F.coalesce(s["text"].rlike(style.pattern), F.lit(False)))
    return F.exists(line["spans"], looks) & _text(line).rlike(style.pattern)


def _goes_on(line: Column, style: Style) -> Column:
    """All spans but blank ones have the font and one of the sizes, there is text, and no other heading starts."""
    real = F.filter(line["spans"], lambda s: F.coalesce(s["text"], F.lit("")).rlike(r"\S"))
    fits = lambda s: F.coalesce((s["font"] == style.font) & F.array_contains(F.array(*(_near(s["size"], z) for z in style.sizes)), True), F.lit(False))
    ok = (F.size(real) > 0) & F.forall(real, fits)
    return ok & ~_text(line).rlike(style.stop) if style.stop else ok


def _leading(items: Column, good) -> Column:
    """The items before the first that is not good."""
    first = F.array_position(F.transform(items, good), False).cast("int")
    return F.when(first == 0, items).otherwise(F.slice(items, 1, F.greatest(first - 1, F.lit(0))))


def _rest(items: Column, start: Column, n: Column | None = None) -> Column:
    """Up to n items from the 0-based start on."""
    return F.slice(items, start + 1, F.size(items) if n is None else n)


def _own(line: Column, style: Style) -> Column:
    """The parts of the title on the line of the mark: what follows the pattern in its span, then the other spans."""
    spans = line["spans"]
    marks = F.transform(spans, lambda s: F.coalesce((s["font"] == style.font) & _near(s["size"], style.size) & s["text"].rlike(style.pattern), F.lit(False)))
    at = F.array_position(marks, True).cast("int")
    tail = F.filter(_rest(spans, at), lambda s: F.coalesce(s["text"], F.lit("")) != "")
    return F.array(F.regexp_replace(F.element_at(spans, at)["text"], style.pattern, ""), F.array_join(F.transform(tail, lambda s: s["text"]), " "))


def _join(parts: Column) -> Column:
    """Parts without outer and double blanks, with a blank between two unless the first ends in a dash."""
    clean = F.filter(F.transform(parts, lambda p: _strip(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    add = lambda a, p: F.when((a == "") | a.rlike("[-–—]$"), F.concat(a, p)).otherwise(F.concat_ws(" ", a, p))
    return F.aggregate(clean, F.lit(""), add)


def gather(spans: DataFrame) -> DataFrame:
    """(pdf_page, blocks array<struct<block, is_text, lines array<struct<line, spans>>>>), all in order. One shuffle, by page."""
    rows = spans.repartition("pdf_page")
    lines = rows.groupBy("pdf_page", "block", "line").agg(F.min("is_text").alias("is_text"), F.array_sort(F.collect_list(F.struct("span", "text", "font", "size"))).alias("spans"))
    blocks = lines.groupBy("pdf_page", "block").agg(F.min("is_text").alias("is_text"), F.array_sort(F.collect_list(F.struct("line", "spans"))).alias("lines"))
    return blocks.groupBy("pdf_page").agg(F.array_sort(F.collect_list(F.struct("block", "is_text", "lines"))).alias("blocks"))


def titles(spans: DataFrame, styles: list[Style]) -> DataFrame:
    """(pdf_page, block, line, level, title) of every heading, empty where no title follows. The first style that fits a line is its level.

    A title goes on over the lines of its block and, if none of these breaks it off, over whole blocks
    of text that only go on, at most more_blocks of them.
    """
    pages = gather(spans)
    at_block = pages.select("pdf_page", "blocks", F.posexplode("blocks").alias("b", "here")).where("here.is_text")
    rows = at_block.select("pdf_page", "blocks", "b", "here", F.posexplode("here.lines").alias("l", "own"))
    level = F.coalesce(*(F.when(is_mark(F.col("own"), s), s.level) for s in styles))
    rows = rows.withColumn("level", level).where("level IS NOT NULL")

    def title(s: Style) -> Column:
        good = lambda line: _goes_on(line, s)
        below = _rest(F.col("here.lines"), F.col("l") + 1)
        near = _leading(below, good)
        following = _rest(F.col("blocks"), F.col("b") + 1, F.lit(s.more_blocks))
        whole = _leading(following, lambda k: k["is_text"] & (F.size(k["lines"]) > 0) & F.forall(k["lines"], good))
        far = F.when(F.size(near) == F.size(below), F.flatten(F.transform(whole, lambda k: k["lines"]))).otherwise(F.slice(below, 1, 0))
        after = F.transform(F.concat(near, far), _text)
        return _join(F.concat(_own(F.col("own"), s), after) if s.inline else after)

    shown = F.coalesce(*(F.when(F.col("level") == s.level, title(s)) for s in styles))
    return rows.select("pdf_page", F.col("here.block").alias("block"), F.col("own.line").alias("line"), "level", shown.alias("title"))
