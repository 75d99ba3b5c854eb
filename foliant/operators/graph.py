"""The cross-reference graph: subdivision of entries, edges, and checks for cycles, dangling targets and degrees."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OVERSIZE, FIRST_N, SECOND_N, MIN_SHARED, MOST_EDGES = 7, 5, 3, 2, 5


def _pick(parents: DataFrame, pool: DataFrame, n: int) -> DataFrame:
    """(parent, sub): for each parent the n terms of the pool that share most of its sections, two at least, ties by name."""
    shared = parents.select("parent", "section_ref").distinct().join(pool.select("sub", "section_ref").distinct(), "section_ref").where("parent <> sub")
    counts = shared.groupBy("parent", "sub").agg(F.count("*").alias("k")).where(F.col("k") >= MIN_SHARED)
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.col("k").desc(), "sub"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).select("parent", "sub")


def subdivide(locators: DataFrame, pool: DataFrame) -> DataFrame:
    """(parent, sub, section_ref, folio) of entries with more than seven locators; sub is null for locators that stay with the parent.

    A first pass picks five subentries; where more than seven locators are left, a second picks
    three more by what they share with the rest. locators (parent, section_ref, folio), pool (sub,
    section_ref, folio).
    """
    big = locators.groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") > OVERSIZE).select("parent")
    own = locators.join(big, "parent")
    first = _pick(own, pool, FIRST_N)
    covered = lambda chosen: chosen.join(pool, "sub").join(own.select("parent", "section_ref").distinct(), ["parent", "section_ref"]).select("parent", "section_ref").distinct()
    rest = own.join(covered(first), ["parent", "section_ref"], "left_anti")
    still = rest.groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") > OVERSIZE).select("parent")
    second = _pick(rest.join(still, "parent"), pool.join(first.select("sub").distinct(), "sub", "left_anti"), SECOND_N)
    chosen = first.union(second)
    subs = chosen.join(pool, "sub").join(own.select("parent", "section_ref").distinct(), ["parent", "section_ref"]).select("parent", "sub", "section_ref", "folio")
    left = own.join(covered(chosen), ["parent", "section_ref"], "left_anti").select("parent", F.lit(None).cast("string").alias("sub"), "section_ref", "folio")
    return subs.union(left)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) whose target is no node (id)."""
    return edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")


def crowded(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree")).where(F.col("degree") > most)


def settled(df: DataFrame) -> DataFrame:
    """df kept in the checkpoint folder, so that a loop's plan does not grow."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="foliant-"))
    return df.checkpoint()


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges left once nodes without outgoing or incoming edges have been taken off again and again."""
    left = settled(edges)
    n = left.count()
    while n:
        starts, ends = left.select(F.col("src").alias("dst")).distinct(), left.select(F.col("dst").alias("src")).distinct()
        left = settled(left.join(starts, "dst", "left_semi").join(ends, "src", "left_semi").select("src", "dst"))
        now = left.count()
        if now == n:
            break
        n = now
    return left


def _least_reached(edges: DataFrame) -> DataFrame:
    """(node, least): the least node that each node reaches along the edges, itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    labels = settled(nodes.select("node", F.col("node").alias("least")))
    while True:
        ahead = edges.join(labels, edges["dst"] == labels["node"]).groupBy("src").agg(F.min("least").alias("ahead"))
        moved = settled(labels.join(ahead, F.col("node") == F.col("src"), "left").select("node", F.least("least", F.coalesce("ahead", "least")).alias("now"), "least"))
        labels = moved.select("node", F.col("now").alias("least"))
        if moved.where("now < least").isEmpty():
            return labels


def on_cycles(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) that lie on a cycle: empty if there is none. Repeated edges count once; an edge to itself is a cycle.

    Nodes without a way in or out are peeled off. Of the rest, nodes on one cycle reach, and are reached by,
    the same least node, so edges between nodes that differ in either go, and so on until none goes.
    What is left of a part then all reaches its least node and is reached by it.
    """
    left = settled(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    while True:
        left = _peeled(left)
        n = left.count()
        if not n:
            return left
        to = _least_reached(left)
        back = _least_reached(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        mark = to.withColumnRenamed("least", "a").join(back.withColumnRenamed("least", "b"), "node")
        u, v = (mark.select(F.col("node").alias(c), F.struct("a", "b").alias(f"{c}_mark")) for c in ("src", "dst"))
        left = settled(left.join(u, "src").join(v, "dst").where("src_mark = dst_mark").select("src", "dst"))
        if left.count() == n:
            return left


def section_path(spark, sections: DataFrame) -> DataFrame:
    """(section_id, root, depth) of every section; sections (section_id, parent_id). A parent that is no section is a root.

    Hops to a farther ancestor are joined with themselves, so their length doubles in each round, until none
    leads on. Raises if a cycle is found: hops then outgrow the number of sections.
    """
    ids = sections.select("section_id").distinct()
    hops = settled(sections.where("parent_id IS NOT NULL").select("section_id", F.col("parent_id").alias("at"), F.lit(1).alias("depth")).distinct())
    n, reached = hops.count(), 1
    while n:
        further = hops.select(F.col("section_id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        joined = settled(hops.join(further, "at", "left"))
        hops = joined.select("section_id", F.coalesce("next", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if joined.where("more IS NOT NULL").isEmpty():
            break
        if reached > n:
            raise ValueError("sections have a cycle of parents")
        reached *= 2
    ends = hops.groupBy("section_id").agg(F.max_by("at", "depth").alias("at"), F.max("depth").alias("depth"))
    return ids.join(ends, "section_id", "left").select("section_id", F.coalesce("at", "section_id").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"))


def see_edges(variants: DataFrame) -> DataFrame:
    """(slug, id): from the slug of each variant to the entries that have it, but not to an entry with that very slug; variants (id, v)."""
    from foliant.functions import text as T

    return variants.select(T.slugify(F.col("v")).alias("slug"), "id").where("slug <> id").distinct()
