"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is the set of its distinct ``SHINGLE``-word shingles. Items are partitioned by set size
into bands of powers of two, and the items of a band share one sketch length: the s smallest
shingles under one random order (a bottom-s MinHash). If a document holds a share t of the n
shingles of an item, it misses at most n - ceil(t*n) of them, so with s = n - ceil(t*n) + 1, n the
largest size of the band, the sketch and the document share a shingle for sure. The search thus loses
no document however long it is, which banded MinHash of whole documents cannot promise: the Jaccard
similarity of a short item and a long document is close to 0. A document that is too short for a
band (fewer shingles than t times its smallest item) is no match either.

Candidates are verified by exact containment: the distinct shingles of the item in the document,
as text.

Cost: one scan of the documents, whose shingle hashes stream out of each row into a join with the
sketches, and a second scan that keeps only the candidate documents. Sketches, candidates and item
sets are broadcast below ``BROADCAST_ROWS`` rows, which are counted first, and joined by shuffles
beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import ascii_lower, fresh, pinned, words, written

SHINGLE = 5
CONTAINMENT = 75
BROADCAST_ROWS = 200_000


def shingles(ws: Column, k: int = SHINGLE) -> Column:
    """The k-word shingles of the words, in order; a shorter text is one shingle, no words give none."""
    at = F.when(F.size(ws) >= k, F.sequence(F.lit(0), F.size(ws) - k)).otherwise(F.array().cast("array<int>"))
    whole = F.when(F.size(ws) > 0, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(ws) < k, whole).otherwise(F.transform(at, lambda i: F.concat_ws(" ", *(F.get(ws, i + j) for j in range(k)))))


def shingle_ranks(ws: Column, k: int = SHINGLE) -> Column:
    """The place of each shingle in the random order of MinHash: a 64-bit hash of its words."""
    at = F.when(F.size(ws) >= k, F.sequence(F.lit(0), F.size(ws) - k)).otherwise(F.array().cast("array<int>"))
    whole = F.when(F.size(ws) > 0, F.array(F.xxhash64(F.array_join(ws, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(ws) < k, whole).otherwise(F.transform(at, lambda i: F.xxhash64(*(F.get(ws, i + j) for j in range(k)))))


def need(n: Column, percent: int) -> Column:
    """The shingles that a match has of n."""
    return F.ceil(n * percent / F.lit(100)).cast("int")


def item_sets(items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(item_id, n, shingles, ranks): the distinct shingles of each item that has a word, and their ranks, sorted."""
    sets = items.select(F.col(item_id).alias("item_id"), words(ascii_lower(F.col(text))).alias("ws")).where(F.size("ws") > 0)
    sets = sets.select("item_id", F.array_distinct(shingles(F.col("ws"), k)).alias("shingles"), F.sort_array(F.array_distinct(shingle_ranks(F.col("ws"), k))).alias("ranks"))
    return sets.select("item_id", F.size("shingles").alias("n"), "shingles", "ranks")


def sketches(sets: DataFrame, percent: int = CONTAINMENT) -> DataFrame:
    """(item_id, band, least, rank): the bottom-s sketch of each item, of the length of its size band."""
    most = (F.pow(F.lit(2), F.col("band") + 1) - 1).cast("int")
    banded = sets.select("item_id", "ranks", F.floor(F.log2("n")).cast("int").alias("band"))
    least = need(F.pow(F.lit(2), F.col("band")).cast("int"), percent)
    return banded.select("item_id", "band", least.alias("least"), F.explode(F.slice("ranks", F.lit(1), most - need(most, percent) + 1)).alias("rank"))


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", percent: int = CONTAINMENT, k: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(key, item_id, found, n): each item of whose n shingles a document holds at least percent per cent; once for equal keys.

    Null and empty texts match nothing, nor do items without a word. Items with fewer than k words
    are one shingle, which only a document of just these words holds. Equal items each match.
    """

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(broadcast_rows + 1).count() <= broadcast_rows else df

    sets = written(item_sets(items, k=k), "items")
    table = sketches(sets, percent)
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(key, text).alias("_row"), F.col(text).alias("_text"))
    ranks = rows.select("_row", words(ascii_lower(F.col("_text"))).alias("_ws")).select("_row", pinned(shingle_ranks(F.col("_ws"), k)).alias("_ranks"))
    ranks = ranks.select("_row", F.size("_ranks").alias("_n"), F.explode("_ranks").alias("_rank"))
    met = ranks.join(sent(table), (F.col("_rank") == F.col("rank")) & (F.col("_n") >= F.col("least")))
    candidates = written(met.select("_row", "item_id").distinct(), "candidates")

    wanted = rows.join(sent(candidates.select("_row").distinct()), "_row", "left_semi").select("_row", "_key", words(ascii_lower(F.col("_text"))).alias("_ws"))
    wanted = wanted.select("_row", "_key", pinned(F.array_distinct(shingles(F.col("_ws"), k))).alias("_set"))
    pairs = wanted.join(sent(candidates), "_row").join(sent(sets.select("item_id", "n", "shingles")), "item_id")
    verified = pairs.select("_key", "item_id", F.size(F.array_intersect("_set", "shingles")).alias("found"), "n").where(F.col("found") >= need(F.col("n"), percent))
    return verified.groupBy(F.col("_key").alias(key), "item_id", "n").agg(F.max("found").alias("found")).select(key, "item_id", "found", "n")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", percent: int = CONTAINMENT) -> DataFrame:
    """docs without the documents that contain an item. Documents with a null key are judged by their text alone."""
    flagged = contained(docs.select(F.xxhash64(key, text).alias("_h"), F.col(text)), items, "_h", text, percent).select("_h").distinct()
    h = fresh(docs, "h")
    return docs.withColumn(h, F.xxhash64(key, text)).join(flagged.withColumnRenamed("_h", h), h, "left_anti").drop(h)
