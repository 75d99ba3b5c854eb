"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots, far more than there are shards. Bytes are summed
per slot, and a slot-to-shard map sends whole slots to shards. The map is a table with a row for each
version and slot. Rebalancing reads the current version and adds one in which it moves as few slots
as it needs; every other record stays where it is.

Cost: one scan with a map-side combined sum over at most ``n_slots`` keys, and one narrow shuffle
(no texts) that numbers the rows of each slot. The driver holds only the map, of ``n_slots`` rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import fresh, hash60, int_array, small_table

N_SLOTS = 4096
OVERHEAD = 8


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def slot_of(key: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    """The virtual slot of a record. Key and text both count, so that rows with a null key spread too."""
    return F.pmod(hash60("slot", key, text), F.lit(n_slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """A version of the map: shard[i] is the shard of slot i."""

    version: int
    n_shards: int
    shard: tuple[int, ...]

    def column(self, slot: Column) -> Column:
        return F.get(int_array(self.shard), slot)


def slot_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """(slot int, bytes long, n_rows long) of each slot that has a record: at most n_slots rows."""
    return (
        docs.select(slot_of(F.col(key), F.col(text), n_slots).alias("slot"), record_size(F.col(text)).alias("size"))
        .groupBy("slot")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))
    )


def initial_map(load: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """Version 1: slots by falling bytes, ties by number, each to the shard with the fewest bytes so far."""
    shard, heap = [0] * n_slots, [(0, s) for s in range(n_shards)]
    empty = [s for s in range(n_slots) if not load.get(s)]
    for slot in sorted((s for s in range(n_slots) if load.get(s)), key=lambda s: (-load[s], s)):
        used, s = heapq.heappop(heap)
        shard[slot] = s
        heapq.heappush(heap, (used + load[slot], s))
    for i, slot in enumerate(empty):
        shard[slot] = i % n_shards
    return SlotMap(1, n_shards, tuple(shard))


def rebalance(current: SlotMap, load: dict[int, int], n_shards: int) -> SlotMap:
    """The next version for n_shards shards: slots leave only shards above the mean, and only while that evens the sizes."""
    shard = [s if s < n_shards else -1 for s in current.shard]
    used = [0] * n_shards
    for slot, s in enumerate(shard):
        if s >= 0:
            used[s] += load.get(slot, 0)
    heap = [(u, s) for s, u in enumerate(used)]
    heapq.heapify(heap)
    homeless = sorted((s for s in range(len(shard)) if shard[s] < 0), key=lambda s: (-load.get(s, 0), s))
    for slot in homeless:
        u, s = heapq.heappop(heap)
        shard[slot], used[s] = s, u + load.get(slot, 0)
        heapq.heappush(heap, (used[s], s))
    mean = sum(used) / n_shards
    for slot in sorted(range(len(shard)), key=lambda s: (-load.get(s, 0), s)):
        size, own = load.get(slot, 0), shard[slot]
        if not size or used[own] - size < mean:
            continue
        low = min(range(n_shards), key=lambda s: (used[s], s))
        if used[low] + size <= mean or used[low] + size < used[own]:
            shard[slot], used[own], used[low] = low, used[own] - size, used[low] + size
    return SlotMap(current.version + 1, n_shards, tuple(shard))


def save_map(spark: SparkSession, slots: SlotMap, path: str) -> None:
    """Add a version to the table at path: (slot int, shard int, n_shards int, version int). A version is never written twice."""
    rows = small_table(spark, [(i, s, slots.n_shards) for i, s in enumerate(slots.shard)], "slot int, shard int, n_shards int")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={slots.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the map at path, the last by default: one row for each slot reaches the driver."""
    table = spark.read.parquet(path)
    wanted = version if version is not None else table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == wanted).orderBy("slot").collect()
    return SlotMap(int(wanted), rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def rebalance_stored(docs: DataFrame, path: str, n_shards: int, key: str = "doc_id", text: str = "text") -> SlotMap:
    """Edit the map at path for n_shards shards and the bytes of docs: the next version, which is stored and returned."""
    current = load_map(docs.sparkSession, path)
    load = {r["slot"]: r["bytes"] for r in slot_bytes(docs, key, text, len(current.shard)).collect()}
    slots = rebalance(current, load, n_shards)
    save_map(docs.sparkSession, slots, path)
    return slots


def stored_map(docs: DataFrame, n_shards: int, path: str, key: str = "doc_id", text: str = "text") -> tuple[SlotMap, dict[int, tuple[int, int]]]:
    """Version 1 of the map for docs, written to path and read from there, and (bytes, rows) by slot."""
    slots, stats = build_map(docs, n_shards, key, text)
    save_map(docs.sparkSession, slots, path)
    return load_map(docs.sparkSession, path), stats


def build_map(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> tuple[SlotMap, dict[int, tuple[int, int]]]:
    """Version 1 of the map for docs, and (bytes, rows) by slot. At most n_slots rows reach the driver."""
    stats = {r["slot"]: (r["bytes"], r["n_rows"]) for r in slot_bytes(docs, key, text, n_slots).collect()}
    return initial_map({s: b for s, (b, _) in stats.items()}, n_shards, n_slots), stats


def assign(docs: DataFrame, slots: SlotMap, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with its shard (int) added, under a name that docs does not have. No shuffle.

    Null keys and texts are hashed like any value; equal rows get equal shards; an empty table stays
    empty.
    """
    return docs.withColumn(fresh(docs, "shard"), slots.column(slot_of(F.col(key), F.col(text), len(slots.shard))))


def positions(docs: DataFrame, slots: SlotMap, stats: dict[int, tuple[int, int]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot): slot is the row's place in its shard, without gaps from 0.

    A place is the number of rows in earlier virtual slots of the shard, from the map, plus the rank
    inside the virtual slot, so no task sorts a whole shard. Equal rows get places in any order.
    """
    n_slots, seen, before = len(slots.shard), [0] * slots.n_shards, [0] * len(slots.shard)
    for s in range(n_slots):
        before[s] = seen[slots.shard[s]]
        seen[slots.shard[s]] += stats.get(s, (0, 0))[1]
    rows = docs.select(
        F.col(key),
        record_size(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("text_crc32"),
        slot_of(F.col(key), F.col(text), n_slots).alias("virtual_slot"),
    )
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size"))
    return rows.withColumn("rank", rank).select(
        key,
        "size",
        "text_crc32",
        slots.column(F.col("virtual_slot")).alias("shard"),
        (F.get(int_array(before), F.col("virtual_slot")) + F.col("rank") - 1).cast("long").alias("slot"),
        "virtual_slot",
        F.lit(slots.version).alias("map_version"),
    )
