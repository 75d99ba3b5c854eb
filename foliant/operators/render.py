"""Lines of the index and of its tables, as rows that any sink writes in order.

A line has the key by which it is sorted, the rank of its kind (entries, synthetic entries, cross-references),
its place below its head, and its text. Locators are collapsed to ranges of folios.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import index
from foliant.operators.editorial import NBSP

INDENT = "    "
ENTRY, SYNTHETIC, XREF = 0, 1, 2


def numbers(section_ref: Column) -> Column:
    """A section as numbers, for sorting."""
    return F.transform(F.split(section_ref, r"\."), lambda x: x.try_cast("int"))


def locator_lists(locators: DataFrame, key: str) -> DataFrame:
    """(key, where): the locators (key, section_ref, folio) of each key in order of section and folio, folios in ranges."""
    runs = index.folio_runs(locators.select(key, "section_ref", "folio").distinct(), [key])
    folios = F.when(F.col("lo").isNull() | (F.col("lo") == F.col("hi")), F.concat(F.lit(f"p.{NBSP}"), F.col("folio"))).otherwise(F.concat(F.lit(f"pp.{NBSP}"), F.col("lo").cast("string"), F.lit("–"), F.col("hi").cast("string")))
    label = F.concat(F.lit(f"§{NBSP}"), F.col("section_ref"), F.lit(" ("), folios, F.lit(")"))
    each = F.struct(numbers(F.col("section_ref")).alias("n"), F.coalesce("lo", F.lit(-1)).alias("lo"), label.alias("label"))
    return runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["label"]), ", ").alias("where"))


def _with(head: Column, where: Column) -> Column:
    return F.when(where.isNull() | (where == ""), head).otherwise(F.concat(head, F.lit(", "), where))


def variants_clause(shown: DataFrame) -> DataFrame:
    """(id, also): the shown variants (id, rank, variant) in brackets."""
    return shown.groupBy("id").agg(F.concat(F.lit(" *(also: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "variant"))), lambda x: x["variant"]), "; "), F.lit(")*")).alias("also"))


def entry_lines(entries: DataFrame, lists: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """(key, kind, head, place, line) of entries (id, canonical) with their lists (id, where) and shown variants."""
    rows = entries.join(lists, "id", "left")
    if shown is not None:
        rows = rows.join(variants_clause(shown), "id", "left")
    else:
        rows = rows.withColumn("also", F.lit(None).cast("string"))
    line = _with(F.concat("canonical", F.coalesce("also", F.lit(""))), F.col("where"))
    return rows.select(T.sort_key(F.col("canonical")).alias("key"), F.lit(ENTRY).alias("kind"), F.col("canonical").alias("head"), F.lit(0).alias("place"), line.alias("line"))


def sub_lines(subs: DataFrame, lists: DataFrame, removed: list[str] | None = None) -> DataFrame:
    """Lines of subentries (parent, sub) with lists (parent, sub, where), in order of their own keys; removed ones are left out."""
    rows = subs.where(~F.col("sub").isin(removed or [])).join(lists, ["parent", "sub"], "left")
    place = F.row_number().over(Window.partitionBy("parent").orderBy(T.sort_key(F.col("sub")), "sub"))
    return rows.select(T.sort_key(F.col("parent")).alias("key"), F.lit(ENTRY).alias("kind"), F.col("parent").alias("head"), place.alias("place"), _with(F.concat(F.lit(INDENT), F.col("sub")), F.col("where")).alias("line"))


def synthetic_lines(siblings: DataFrame, lists: DataFrame, carried: DataFrame | None = None, removed: list[str] | None = None) -> DataFrame:
    """A stem, and below it its siblings (stem, canonical) in order of name with their own lists (canonical, where), or the stem's union.

    carried (canonical, also) are variants of entries that were dropped in favour of the sibling.
    """
    kept = siblings.where(~F.col("canonical").isin(removed or []))
    rows = kept.join(lists, "canonical", "left")
    rows = rows.join(carried, "canonical", "left") if carried is not None else rows.withColumn("also", F.lit(None).cast("string"))
    place = F.row_number().over(Window.partitionBy("stem").orderBy("canonical"))
    body = rows.select("stem", place.alias("place"), _with(F.concat(F.lit(INDENT), F.col("canonical"), F.coalesce("also", F.lit(""))), F.col("where")).alias("line"))
    heads = siblings.select("stem").distinct().select("stem", F.lit(0).alias("place"), F.col("stem").alias("line"))
    return heads.union(body).select(F.lower("stem").alias("key"), F.lit(SYNTHETIC).alias("kind"), F.col("stem").alias("head"), "place", "line")


def xref_lines(xrefs: DataFrame) -> DataFrame:
    """Lines of cross-references (head, target)."""
    return xrefs.select(F.lower("head").alias("key"), F.lit(XREF).alias("kind"), F.col("head"), F.lit(0).alias("place"), F.concat(F.col("head"), F.lit(". See "), F.col("target"), F.lit(".")).alias("line"))


def consolidated_lines(pairs: DataFrame) -> DataFrame:
    """One line for a singular and its plural: (singular, plural, target, where), target for cross-references, else where."""
    ending = F.substr(F.col("plural"), F.length("singular") + 1)
    y = F.col("plural").endswith("ies")
    shown = F.when(y, F.concat("singular", F.lit("(ies)"))).otherwise(F.concat("singular", F.lit("("), ending, F.lit(")")))
    line = F.when(F.col("target").isNotNull(), F.concat(shown, F.lit(". See "), F.col("target"), F.lit("."))).otherwise(_with(shown, F.col("where")))
    return pairs.select("singular", "plural", line.alias("line"))


def table_lines(rows: DataFrame, italic: bool = False) -> DataFrame:
    """(sort_key, place, line) of a table of (sort_key, head, cite, where, below); below lists (label, where) of parts, indented."""
    head = F.concat(F.lit("*"), F.col("head"), F.lit("*")) if italic else F.col("head")
    named = F.when(F.col("cite").isNull(), head).otherwise(F.concat(head, F.lit(", "), F.col("cite")))
    parts = F.transform(F.array_sort("below"), lambda x: _with(F.concat(F.lit(INDENT), x["label"]), x["where"]))
    return rows.select("sort_key", F.posexplode(F.concat(F.array(_with(named, F.col("where"))), parts)).alias("place", "line"))


def merged(streams: list[DataFrame]) -> DataFrame:
    """(letter, ord, line): all streams in order of key, kind, head and place inside their letter; a divider, ord 0, heads each letter."""
    rows = streams[0]
    for more in streams[1:]:
        rows = rows.unionByName(more)
    letter = F.upper(F.left("key", F.lit(1)))
    order = F.row_number().over(Window.partitionBy("letter").orderBy("key", "kind", "head", "place", "line"))
    body = rows.withColumn("letter", letter).withColumn("ord", order).select("letter", "ord", "line")
    heads = body.select("letter").distinct().select("letter", F.lit(0).alias("ord"), F.concat(F.lit("## "), F.col("letter")).alias("line"))
    return heads.union(body)


def recapitalized(lines: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Lines with curated replacements that differ by case only, in order."""
    out = F.col("line")
    for wrong, right in pairs:
        if wrong.lower() != right.lower():
            raise ValueError(f"{wrong!r} and {right!r} differ by more than case")
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return lines.withColumn("line", out)


def metadata_block(values: dict[str, object], frozen: str = "built_at") -> list[str]:
    """A comment with a line for each value in order of name, but the frozen one."""
    return ["<!--", "index metadata", *(f"{k}={values[k]}" for k in sorted(values) if k != frozen), "-->"]
