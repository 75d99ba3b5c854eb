"""Removal of repeated byte strings by distributed prefix doubling over sampled suffixes.

Wanted: every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else. Ranking
all suffixes would shuffle many times the input, so suffixes are thinned first, without losing a
repeat: of the ``SEED``-byte strings inside each window of LENGTH bytes, the least by hash is its
anchor. Equal windows have the same anchor at the same place, so it is enough to compare windows
with equal anchors.

Ranks are fingerprints: that of a string of length 2s is made of the pair at offsets 0 and s, up to
SEED bytes, inside the scan. Then Spark sorts (rank, longer rank) pairs at growing lengths and drops
what has become unique. At each level the windows of an anchor are taken in runs of ``g`` starts
(all, 44, 1). Two ranks are compared: that of what all windows of the run share and that of all the
bytes that they cover. If the first is unique, no window of the run repeats; if the second is
shared, all do; only the rest goes to the next level, with one row for each distinct second rank.
Large groups of copies are thus settled at the first level.

Cost: three scans of documents, the second and third only of those with open windows, plus one to
apply the result; about 2/(LENGTH-SEED+2) anchors for each byte are written, and shuffled as counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import written
from foliant.llm.tokens import mix, pieces, text_bytes

LENGTH, SEED = 400, 64
LEVELS = (44, 1)
#: Row keys (8 bytes) are broadcast up to this many, beyond that joined by a shuffle.
BROADCAST_ROWS = 2_000_000

_rng = np.random.default_rng(400)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _rng.integers(1, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Low bits of a sort key hold the place, so that the leftmost of equal hashes is least.
_PLACE_BITS = 28


def seed_ranks(raw: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A fingerprint of the seed bytes from each place, by doubling; seed is a power of two."""
    rank, s, i = _BYTE[raw], 1, 0
    while s < seed:
        rank = rank[:-s] * _STEPS[i] + rank[s:]
        s, i = 2 * s, i + 1
    return mix(rank)


def window_anchors(rank: np.ndarray, width: int) -> np.ndarray:
    """The place of the least rank, leftmost of equals, in each run of width ranks."""
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = (rank & ~low) | np.arange(len(rank), dtype=np.uint64)
    s = 1
    while 2 * s <= width:
        least = np.minimum(least[:-s], least[s:])
        s *= 2
    if width > s:
        least = np.minimum(least[: len(least) - (width - s)], least[width - s :])
    return (least & low).astype(np.int64)


def _digest(data: bytes, place: int, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size, salt=int(place).to_bytes(8, "little")).digest()


def _key(data: bytes, place: int) -> int:
    return int.from_bytes(_digest(data, place, 8), "little", signed=True)


ROW = pa.schema([("row", pa.int64()), ("a", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("shared", pa.int64()), ("whole", pa.binary())])
ROW_DDL = "row long, a int, lo int, hi int, shared long, whole binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor of each text: its windows start at lo to hi."""
    for batch in batches:
        for piece in pieces(batch, "text", 1_000_000):
            raw, offsets = text_bytes(piece.column("text"))
            rows: list[tuple] = []
            for row, at, end in zip(piece.column("row").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if end - at < LENGTH:
                    continue
                text = raw[at:end]
                rank = seed_ranks(text)
                anchor = window_anchors(rank, LENGTH - SEED + 1)
                cut = np.flatnonzero(np.diff(anchor)) + 1
                lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(anchor)]]) - 1
                data, places = text.tobytes(), anchor[lo]
                shared = rank[places].view(np.int64).tolist()
                for a, x, y, r in zip(places.tolist(), lo.tolist(), hi.tolist(), shared, strict=True):
                    rows.append((row, a, x, y, r, _digest(data[x : y + LENGTH], a - x)))
                if len(rows) > 20_000:
                    yield _batch(rows, ROW)
                    rows = []
            yield _batch(rows, ROW)


def _runs(g: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For the open windows of each text, a row for each run of g starts, counted back from the anchor.

        A run that does not lie in the text whole has a rank of its own, so it stays open or is unique.
        """
        for batch in batches:
            rows: list[tuple] = []
            for row, text, todo in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("todo").to_pylist(), strict=True):
                data = text.as_py().encode()
                for x in todo:
                    a, lo, hi = x["a"], x["lo"], x["hi"]
                    for j in range((a - hi) // g, (a - lo) // g + 1):
                        first, last = a - (j + 1) * g + 1, a - j * g
                        fits = first >= 0 and last + LENGTH <= len(data)
                        shared = _key(data[last : first + LENGTH], j)
                        rows.append((row, a, max(lo, first), min(hi, last), shared, _digest(data[first : last + LENGTH] if fits else b"%d,%d" % (row, first), j)))
                    if len(rows) > 20_000:
                        yield _batch(rows, ROW)
                        rows = []
            yield _batch(rows, ROW)

    return run


def _settle(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(intervals that repeat, rows that stay open) of one level.

    Rows are counted by (shared, whole) and then by shared, both with a map-side combine, so a rank
    that a third of all texts share is a few counts and never the rows of one task. What goes back to
    single rows goes back by joins, which adaptive execution splits where copies make them uneven.
    """
    held = written(rows, name)
    one = [F.first(c).alias(c) for c in ("row", "a", "lo", "hi")]  # of one row: aggregates see rows in the same order
    groups = held.groupBy("shared", "whole").agg(F.count("*").alias("n"), *one)
    shares = groups.groupBy("shared").agg(F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1").select("shared", "least")
    known = written(groups.join(shares, "shared"), f"{name}_known")
    done = held.join(known.where("n > 1").select("shared", "whole"), ["shared", "whole"], "left_semi").select("row", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("stop"))
    return done, known.where("least = 1").select("row", "a", "lo", "hi")


def _only(docs: DataFrame, ids: DataFrame, how: str, few: bool) -> DataFrame:
    return docs.join(F.broadcast(ids) if few else ids, "row", how)


def repeated(texts: DataFrame) -> DataFrame:
    """(row, start, stop) byte intervals that repeat, end exclusive, possibly overlapping; texts (row, text)."""
    done, left = _settle(texts.where(F.octet_length("text") >= LENGTH).mapInArrow(_anchors, ROW_DDL), "anchors")
    found = [done]
    for g in LEVELS:
        todo = written(left.groupBy("row").agg(F.collect_list(F.struct("a", "lo", "hi")).alias("todo")), "open")
        few = todo.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        chosen = _only(texts, todo.select("row"), "left_semi", few).join(todo, "row").select("row", "text", "todo")
        done, left = _settle(chosen.mapInArrow(_runs(g), ROW_DDL), f"runs{g}")
        found.append(done)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


CUT = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept_chars", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the intervals cover; intervals that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])) if len(start) else np.zeros(0, np.int64)
    return start[new], reach[np.append(new[1:], len(start)) - 1] if len(start) else stop


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            raw, offsets = text_bytes(piece.column("text"))
            spans = piece.column("spans")
            flat, sizes = spans.flatten(), spans.value_lengths().to_numpy()
            starts, stops = (flat.field(c).to_numpy() for c in ("start", "stop"))
            at, removed, chars, kept, lengths, low, high = 0, [], [], [], [], [], []
            for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), sizes.tolist(), strict=True):
                first, last = merged(starts[at : at + n], stops[at : at + n])
                at += n
                edge = np.zeros(b - a + 1, np.int8)
                edge[first], edge[last] = 1, -1
                left = raw[a:b][np.cumsum(edge[:-1], dtype=np.int8) == 0]
                removed.append(b - a - len(left))
                chars.append(int(np.count_nonzero((left & 0xC0) != 0x80)))
                kept.append(left.tobytes())
                lengths.append(len(first))
                low.append(first)
                high.append(last)
            bounds = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            own = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for x in (low, high)], ["start", "stop"])
            columns = [piece.column("key"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(chars, pa.int64()), pa.ListArray.from_arrays(bounds, own), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=CUT)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, kept_chars, spans, kept) of each row of docs: maximal removed runs and the remaining bytes.

    kept_chars counts the remaining bytes that begin a code point, which is the length of a text that
    loses nothing.

    A null text is empty; texts shorter than LENGTH lose nothing; equal rows count as repeats of each
    other; an empty table gives an empty result. Keys are long integers and may be null or repeated.
    """
    texts = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(key), F.col(text)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = written(repeated(texts.select("row", "text")).groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    few = spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ids = spans.select("row")
    touched = _only(texts, ids, "left_semi", few).join(spans, "row").select("key", "text", "spans").mapInArrow(_cut, "key long, n_bytes long, n_removed long, kept_chars long, spans array<struct<start:long,stop:long>>, kept binary")
    rest = _only(texts, ids, "left_anti", few).select("key", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"), F.col("text").cast("binary").alias("kept"))
    return touched.unionByName(rest).withColumnRenamed("key", key)
