"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets are filled up like water: sources get tokens by weight, a source stops at ``max_repeat``
times its size, and the excess is shared out again. The mix is then cut into blocks of
``block_tokens`` tokens, and blocks go to sources one by one by the highest quotient target/(2k+1).
The method is house-monotone, so the quotas of the first j shards are the seats after j*M/n blocks,
and the differences are integer quotas for each shard. Last, each source lays its documents in a
seeded random order and cuts that line into blocks. From a seeded start and round the corner, the
shards take their quotas of blocks one after the other.

Cost: one map-side combined sum over sources, one narrow shuffle (no texts) by (source, bucket) for
the running sums. A hot source spreads over ``BUCKETS`` buckets. The driver holds one row for each
source, and refuses more than ``MAX_SOURCES``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import WORD, fresh, hash60, small_table, written

WEIGHTS = (3, 1, 2)
BLOCK_TOKENS = 32
BUCKETS = 1024
N_SHARDS = 24
MAX_SOURCES = 100_000
SHARE = Fraction(3, 2)


def n_words(text: Column) -> Column:
    """The number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass
class Source:
    name: str | None
    size: int
    weight: int
    target: Fraction = Fraction(0)
    seats: int = 0


def fill(sources: list[Source], total: Fraction, max_repeat: int = 2) -> None:
    """Targets by weight, none above max_repeat times its source's size; what does not fit is shared again."""
    free = sorted((s for s in sources), key=lambda s: Fraction(max_repeat * s.size, s.weight))
    left, weight = total, sum(s.weight for s in free)
    for s in free:
        if max_repeat * s.size * weight <= left * s.weight:
            s.target = Fraction(max_repeat * s.size)
        else:
            s.target = left * s.weight / weight
        left, weight = left - s.target, weight - s.weight


def blocks_of(size: int, block: int) -> int:
    return -(-size // block)


def apportion(sources: list[Source], n_blocks: int, block: int, max_repeat: int = 2) -> list[int]:
    """Seats by highest quotients target/(2k+1), ties to the earlier source, at most max_repeat times a source's blocks.

    It starts from rounded shares and then adds or removes single seats, so it takes as many steps as
    there are sources, not blocks.
    """
    import heapq

    total = sum((s.target for s in sources), Fraction(0))
    if not total or n_blocks <= 0:
        return [0] * len(sources)
    cap = [max_repeat * blocks_of(s.size, block) for s in sources]
    seats = [min(c, floor(s.target * n_blocks / total + Fraction(1, 2))) for s, c in zip(sources, cap, strict=True)]
    up = [(-s.target / (2 * k + 1), i) for i, (s, k, c) in enumerate(zip(sources, seats, cap, strict=True)) if k < c and s.target]
    down = [(s.target / (2 * k - 1), -i) for i, (s, k) in enumerate(zip(sources, seats, strict=True)) if k]
    heapq.heapify(up)
    heapq.heapify(down)
    have = sum(seats)
    while have < n_blocks and up:
        _, i = heapq.heappop(up)
        seats[i], have = seats[i] + 1, have + 1
        if seats[i] < cap[i]:
            heapq.heappush(up, (-sources[i].target / (2 * seats[i] + 1), i))
    while have > n_blocks and down:
        _, i = heapq.heappop(down)
        seats[-i], have = seats[-i] - 1, have - 1
        if seats[-i]:
            heapq.heappush(down, (sources[-i].target / (2 * seats[-i] - 1), i))
    return seats


def shard_quotas(sources: list[Source], n_blocks: int, n_shards: int, block: int) -> list[list[int]]:
    """For each shard, the integer quota of each source. They add up to the seats of the whole mix."""
    upto = [apportion(sources, n_blocks * j // n_shards, block) for j in range(n_shards + 1)]
    return [[b - a for a, b in zip(x, y, strict=True)] for x, y in zip(upto, upto[1:], strict=False)]


def source_plan(sizes: DataFrame, source: str, size: str, block: int = BLOCK_TOKENS, weights: tuple[int, ...] = WEIGHTS) -> list[Source]:
    """One row for each source, in order of code points with null last: target and seats."""
    rows = sizes.groupBy(source).agg(F.sum(size)).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    plan = [Source(n, s, weights[i % len(weights)]) for i, (n, s) in enumerate(rows)]
    fill(plan, SHARE * sum(s.size for s in plan))
    n_blocks = round(sum((s.target for s in plan), Fraction(0)) / block)
    for s, k in zip(plan, apportion(plan, n_blocks, block), strict=True):
        s.seats = k
    return plan


def offset_of(source: Source, seed: int, block: int) -> int:
    """The seeded start of a source's arc of blocks, in tokens."""
    digest = hashlib.md5(f"{seed}|start|{source.name or ''}".encode()).hexdigest()
    return int(digest[:15], 16) % max(1, blocks_of(source.size, block)) * block


def select_blocks(docs: DataFrame, seed: int = 7, block: int = BLOCK_TOKENS, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, n_shards: int = N_SHARDS) -> DataFrame:
    """(key, row, source, size, source_size, target, seats, by_shard, taken) for each row of docs.

    by_shard counts the words of the row in the blocks that each shard takes by its quota, repeats
    included; taken is their sum. row is a hash of key, text and source. A null text has size 0
    and is never taken; a null source is a source; equal rows get places in any order, which changes
    none of the results by row value; an empty table gives an empty result.
    """
    sizes = docs.select(
        F.col(key).alias("_key"),
        F.col(source).alias("_source"),
        # A null source is a key of its own in windows and joins.
        F.coalesce(F.col(source), F.lit("")).alias("_name"),
        F.col(source).isNull().alias("_null"),
        n_words(F.col(text)).alias("_size"),
        hash60(seed, F.col(key), F.col(text)).alias("_order"),
        F.xxhash64(key, text, source).alias("_row"),
    ).withColumn("_bucket", F.floor(F.col("_order") / F.lit(2**60 // BUCKETS)).cast("int"))
    by_bucket = written(sizes.groupBy("_source", "_name", "_null", "_bucket").agg(F.sum("_size").alias("_in")), "mixing")
    plan = source_plan(by_bucket, "_source", "_in", block, weights)
    quotas = shard_quotas(plan, sum(s.seats for s in plan), n_shards, block)
    upto = [list(accumulate((q[i] for q in quotas), initial=0)) for i in range(len(plan))]
    rows = [(s.name or "", s.name is None, s.size, float(s.target), s.seats, offset_of(s, seed, block), u) for s, u in zip(plan, upto, strict=True)]
    # At most MAX_SOURCES rows go to each executor.
    table = F.broadcast(small_table(docs.sparkSession, rows, "p_name string, p_null boolean, source_size long, target double, seats long, _first long, _upto array<long>"))
    by_source = Window.partitionBy("_name", "_null").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select("_name", "_null", "_bucket", F.coalesce(F.sum("_in").over(by_source), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_name", "_null", "_bucket").orderBy("_order", "_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        sizes.withColumn("_end", F.sum("_size").over(inside))
        .join(offsets, ["_name", "_null", "_bucket"])
        .join(table, (F.col("_name") == F.col("p_name")) & (F.col("_null") == F.col("p_null")))
    )
    start = F.col("_before") + F.col("_end") - F.col("_size")
    n_blocks = F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)).cast("long")
    # In the line of blocks, unrolled from the seeded start, the row stands up to three times where seats can reach.
    line = F.col("_blocks") * block
    places = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.col("_start") - F.col("_first") + i * line)

    def words_of(low: Column, high: Column) -> Column:
        return F.aggregate("_places", F.lit(0).cast("long"), lambda a, x: a + F.greatest(F.least(x + F.col("_size"), high * block) - F.greatest(x, low * block), F.lit(0)))

    shards = F.sequence(F.lit(0), F.lit(n_shards - 1))
    return (
        placed.withColumns({"_start": start, "_blocks": n_blocks})
        .withColumn("_places", places)
        .withColumn("by_shard", F.transform(shards, lambda j: words_of(F.get("_upto", j), F.get("_upto", j + 1))))
        .select(
            F.col("_key").alias(key),
            F.col("_row").alias("row"),
            F.col("_source").alias("source"),
            F.col("_size").alias("size"),
            "source_size",
            "target",
            "seats",
            "by_shard",
            F.aggregate("by_shard", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"),
        )
    )


def mixed(docs: DataFrame, seed: int = 7, block: int = BLOCK_TOKENS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it: a row of whose words the mix takes more than half a copy more, once more.

    Rows of which the mix takes nothing go. Rows equal in key, text and source share what the mix takes
    of them all, as evenly as whole copies allow, so null and repeated keys are rows like any other.
    An empty table stays empty.
    """
    row, times = fresh(docs, "row"), fresh(docs, "times")
    chosen = select_blocks(docs, seed, block, key, text, source).select(F.col("row").alias(row), F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).alias("t"))
    share = written(chosen.groupBy(row).agg(F.sum("t").cast("long").alias("_t"), F.count("*").alias("_c")).where("_t > 0"), "mixed")
    uneven = F.col("_t") % F.col("_c") != 0
    marked = docs.withColumn(row, F.xxhash64(key, text, source))
    even = marked.join(share.where(~uneven).select(row, (F.col("_t") / F.col("_c")).cast("int").alias(times)), row)
    if not share.where(uneven).isEmpty():
        place = F.row_number().over(Window.partitionBy(row).orderBy(F.xxhash64(*docs.columns)))
        odd = marked.join(share.where(uneven), row).withColumn(times, (F.floor(F.col("_t") / F.col("_c")) + (place <= F.col("_t") % F.col("_c")).cast("int")).cast("int"))
        even = even.unionByName(odd.drop("_t", "_c"))
    return even.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*docs.columns)
