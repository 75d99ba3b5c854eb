"""Titles that go on over spans, lines and blocks."""

from foliant.operators import titles as L
from foliant.plans.titles import STYLES

B, S = "Sans-Bold", "Serif"


def _rows(spark, blocks):
    """blocks: lists of lines, each a list of (text, font, size); None is a picture."""
    rows = []
    for b, lines in enumerate(blocks):
        for n, line in enumerate(lines or [[(None, None, None)]]):
            rows += [(1, b, n, s, lines is not None, *span) for s, span in enumerate(line)]
    return spark.createDataFrame(rows, "pdf_page bigint, block int, line int, span int, is_text boolean, text string, font string, size double")


def _titles(spark, blocks):
    return [tuple(r) for r in L.titles(_rows(spark, blocks), STYLES).orderBy("block", "line").select("level", "title").collect()]


def test_section_titles(spark):
    head = ("§ 1.02 How to", B, 12.03)
    assert _titles(spark, [[[head]]]) == [(1, "How to")]
    # Further spans of the line count whatever their font; blanks in another font do not break off.
    assert _titles(spark, [[[head, ("  be ", S, 9.0)], [("an\tadvocate", B, 12.0), (" ", "Arial", 8.0)]]]) == [(1, "How to be an advocate")]
    # Body text in the block ends the title, and no later block is read.
    assert _titles(spark, [[[head], [("body", S, 12.0)]], [[("more", B, 12.0)]]]) == [(1, "How to")]
    # At most two blocks more, each whole; no blank after a dash.
    more = [[[(t, B, 12.0)]] for t in ("Rule 702–", "705)", "lost")]
    assert _titles(spark, [[[head]], *more]) == [(1, "How to Rule 702–705)")]
    assert _titles(spark, [[[head]], [[("a", B, 12.0)], [("b", S, 12.0)]], more[0]]) == [(1, "How to")]
    # A picture and another heading end it.
    assert _titles(spark, [[[head]], None, more[0]]) == [(1, "How to")]
    assert _titles(spark, [[[head]], [[("§ 1.03 Next", B, 12.0)]]]) == [(1, "How to"), (1, "Next")]
    assert _titles(spark, [[[("§ 1.02", B, 12.0)]]]) == [(1, "")]
    # Another font or size is no heading; neither are nulls.
    assert _titles(spark, [[[("§ 1.02 x", S, 12.0)], [("§ 1.02 x", B, 12.1)], [(None, B, 12.0)], [("§ 1.02 x", None, None)]]]) == []


def test_chapter_titles(spark):
    mark = [("CHAPTER", B, 24.0), (" 3", B, 14.0)]
    caps = [[[(t, B, 14.0)]] for t in ("THE LAW", "OF", "EVIDENCE", "LOST")]
    assert _titles(spark, [[mark, [("ON", B, 24.0)]], *caps]) == [(0, "ON THE LAW OF EVIDENCE")]
    assert _titles(spark, [[mark], [[("§ 1.01 A", B, 12.0)]]]) == [(0, ""), (1, "A")]
    assert _titles(spark, [[[("CHAPTER X", B, 24.0)]], [[("CHAPTER 3", B, 14.0)]]]) == []


def test_no_spans(spark):
    assert _titles(spark, []) == []
