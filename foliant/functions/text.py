"""Scalar text functions of the index pipeline, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that normalisation replaces.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
LONGER = {"—": "--", "…": "..."}
ONE_TO_ONE = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", " ": " "}
INVISIBLE = "­​﻿"
#: Case-name prefixes that sorting leaves out.
PARTY_PREFIXES = ("In re ", "Ex parte ", "Matter of ", "Estate of ", "United States v. ", "State v. ", "People v. ", "Commonwealth v. ")
#: Heads that get no cross-reference.
STOP_HEADS = ("thing", "way", "part", "type", "kind", "case", "fact", "form", "issue", "matter", "point", "right", "rule", "side", "step", "term", "use", "view")
#: First characters of entries that are cruft.
CRUFT_FIRST = "\"“”‘’()[]{}•*/\\_`~#@$%^&"
#: Leading words that a heading loses, and stop words at its edges.
LEAD_VERBS = (
    "define describe discuss explain consider use plan prepare present employ select address avoid analyze review apply conduct "
    "establish identify choose find understand evaluate create develop build introduce propose how what who why when be do maintain enjoy characterize"
).split()
HEADING_STOPS = "a an the of to and or in for with on as by at is are".split()


def pinned(column: Column) -> Column:
    """The same column, kept out of the filters that Catalyst infers from an explode, so it is computed once."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def collapse(text: Column) -> Column:
    """Runs of white space, in the Unicode sense, become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def canonicalize(text: Column) -> Column:
    """Only invisible characters go."""
    return F.translate(text, INVISIBLE, "")


def normalize(text: Column) -> Column:
    """The matching form: ASCII quotes and dashes, ligatures spelled out, white space collapsed, lower case."""
    out = F.translate(text, "".join(ONE_TO_ONE) + INVISIBLE, "".join(ONE_TO_ONE.values()))
    for short, spelled in (LIGATURES | LONGER).items():
        out = F.replace(out, F.lit(short), F.lit(spelled))
    return F.lower(collapse(out))


def slugify(text: Column) -> Column:
    slug = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug == "", "x").otherwise(slug)


def strip_article(text: Column) -> Column:
    """Without a leading article, if another word follows."""
    return F.regexp_replace(text, r"^(?i:the|an|a)\s+(?=\S)", "")


def sort_key(text: Column) -> Column:
    return F.lower(strip_article(text))


def case_sort_key(name: Column) -> Column:
    """A case name without one leading party prefix, in any case."""
    out = name
    for prefix in reversed(PARTY_PREFIXES):
        out = F.when(F.startswith(F.lower(name), F.lit(prefix.lower())), F.ltrim(F.substr(name, F.lit(len(prefix) + 1)))).otherwise(out)
    return out


def head_noun(text: Column) -> Column:
    return F.element_at(F.split(F.trim(text), r"\s+"), -1)


def first_word(text: Column) -> Column:
    return F.get(F.split(F.trim(text), r"\s+"), F.lit(0))


def lemma(norm: Column) -> Column:
    """A rule-based stand-in for a lemmatiser: regular plural endings come off."""
    n = F.length(norm)
    return (
        F.when(~norm.endswith("s"), norm)
        .when((n > 4) & norm.endswith("ies"), F.concat(F.left(norm, n - 3), F.lit("y")))
        .when((n > 4) & norm.rlike("(ss|x|z|ch|sh)es$"), F.left(norm, n - 2))
        .when((n > 3) & norm.endswith("s") & ~norm.endswith("ss"), F.left(norm, n - 1))
        .otherwise(norm)
    )


def plural(word: Column) -> Column:
    """The regular plural of a word."""
    return (
        F.when(word.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(word, "y$", ""), F.lit("ies")))
        .when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def title_case(title: Column) -> Column:
    """Title case where at least 70 % of the letters are capitals; small words stay low but first and after a colon."""
    letters, capitals = F.length(F.regexp_replace(title, "[^A-Za-z]", "")), F.length(F.regexp_replace(title, "[^A-Z]", ""))
    small = ["a", "an", "and", "as", "at", "but", "by", "for", "in", "nor", "of", "on", "or", "the", "to", "v.", "vs.", "with"]
    words = F.split(F.lower(title), " ")
    # Both reads of words are of the same cheap split of one title.
    cased = F.transform(words, lambda w, i: F.when((i > 0) & w.isin(small) & ~F.coalesce(F.get(words, i - 1).endswith(":"), F.lit(False)), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))))
    return F.when((letters > 0) & (capitals * 10 >= letters * 7), F.array_join(cased, " ")).otherwise(title)


def is_cruft(canonical: Column) -> Column:
    """Entries that are no headings: too short or long, decorated, outline-numbered, or with unbalanced parentheses."""
    count = lambda c: F.length(canonical) - F.length(F.replace(canonical, F.lit(c), F.lit("")))
    return (
        (F.length(canonical) < 2)
        | (F.length(canonical) > 100)
        | F.contains(F.lit(CRUFT_FIRST), F.left(canonical, F.lit(1)))
        | canonical.rlike(r"^[a-z]\.\s+")
        | (count("(") != count(")"))
    )


def is_artifact(surface: Column) -> Column:
    """What tokenisation leaves: fewer than three characters, lone digits, spaced punctuation."""
    return (F.length(surface) < 3) | surface.rlike(r"(^|\s)\d+(\s|$)") | surface.rlike(r"\s[.,;:!?)\]]|[(\[]\s")


def is_acronym(surface: Column) -> Column:
    bare = strip_article(surface)
    return bare.rlike("^[A-Z]{2,6}$")


def is_substantive(head: Column) -> Column:
    return (F.length(head) >= 4) & ~F.lower(head).isin(list(STOP_HEADS))


def has_locator_prefix(text: Column) -> Column:
    return text.rlike(r"^\s*(§|\d{1,2}\.\d{2})")


def suggested_fix(literal: Column, lemmas: Column, plurals: Column) -> Column:
    return (
        F.when((literal == 0) & (lemmas == 0) & (plurals == 0), "noise/none")
        .when((plurals > literal) & (plurals > 0), "bigram_inflected/variant_loss_patch")
        .when((literal == 0) & (lemmas > 0), "lemma_collision/lemma_override")
        .otherwise("unknown/none")
    )


def roman_to_int(text: Column) -> Column:
    """The value of a roman numeral in either case; each sign counts against the next larger one."""
    signs = F.transform(F.filter(F.split(F.lower(text), ""), lambda c: c != ""), lambda c: F.coalesce(F.get(F.array(*map(F.lit, (1, 5, 10, 50, 100, 500, 1000))), F.instr(F.lit("ivxlcdm"), c) - 1), F.lit(0)))
    step = lambda acc, v: F.struct((acc["total"] + F.when(v < acc["last"], -v).otherwise(v)).alias("total"), v.alias("last"))
    return F.aggregate(F.reverse(signs), F.struct(F.lit(0).alias("total"), F.lit(0).alias("last")), step, lambda acc: acc["total"])


def folio_style(folio: Column) -> Column:
    return F.when(folio.rlike("^[0-9]+$"), "arabic").when(folio.rlike("^(?i)[ivxlcdm]+$"), "roman").when(folio.rlike("^[A-Z]-?[0-9]+$"), "prefix")


def folio_int(folio: Column) -> Column:
    style = folio_style(folio)
    return F.when(style == "roman", roman_to_int(folio)).otherwise(F.try_to_number(F.regexp_replace(folio, "[^0-9]", ""), F.lit("999999999")).cast("int"))


def page_region(style: Column, page: Column) -> Column:
    return F.when(style == "roman", "front_matter").when(style == "arabic", "body").when(style == "prefix", "back_matter").when(page < 40, "front_matter").otherwise("body")


def heading_phrases(title: Column) -> Column:
    """The last three and the last two words of a heading, once lead verbs and stop words at its edges are gone."""
    words = F.regexp_extract_all(title, F.lit("[A-Za-z][A-Za-z'-]*"), 0)
    lead, stops = LEAD_VERBS + HEADING_STOPS, HEADING_STOPS
    begin = F.array_position(F.transform(words, lambda w: F.lower(w).isin(lead)), False)
    tail = F.when(begin > 0, F.slice(words, begin.cast("int"), F.size(words))).otherwise(F.array().cast("array<string>"))
    drop = F.array_position(F.reverse(F.transform(tail, lambda w: F.lower(w).isin(stops))), False)
    core = F.when(drop > 0, F.slice(tail, F.lit(1), (F.size(tail) - drop + 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    phrase = lambda n: F.when((F.size(core) >= n) & ~F.lower(F.get(core, F.size(core) - n)).isin(stops), F.lower(F.array_join(F.slice(core, F.greatest(F.size(core) - n + 1, F.lit(1)), F.lit(n)), " ")))
    return F.when(F.size(words) >= 2, F.filter(F.array(phrase(3), phrase(2)), lambda p: p.isNotNull())).otherwise(F.array().cast("array<string>"))


def running_head(head: Column, folio: Column) -> Column:
    """The section that a running head names: without the folio, spaced small capitals joined, white space collapsed; null if nothing is left.

    One pass joins every capital with the run of capitals behind it; what it has joined is no capital run
    any more, so nothing is left for another pass.
    """
    bare = F.when(folio.isNull(), head).otherwise(F.regexp_replace(head, F.concat(F.lit("(?i)\\b\\Q"), F.coalesce(folio, F.lit("")), F.lit("\\E\\b")), F.lit("")))
    parts = F.split(F.regexp_replace(bare, r"\b([A-Z])\s{1,3}([A-Z]{2,})", "\u0001$1\u0002$2\u0001"), "\u0001")
    joined = F.array_join(F.transform(parts, lambda p: F.when(F.contains(p, F.lit("\u0002")), F.initcap(F.lower(F.replace(p, F.lit("\u0002"), F.lit(""))))).otherwise(p)), "")
    out = F.trim(F.regexp_replace(joined, r"\s+", " "))
    return F.when(out != "", out)
