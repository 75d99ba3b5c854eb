"""MinHash near-duplicates by a multi-index Hamming join.

The set of a document is its distinct five-word shingles. Equal sets are one class, whose least
document stands for it. A representative has a signature of ``N_SYMBOLS`` MinHash symbols of
``BITS`` bits. The signature is split into ``N_CHUNKS`` chunks. If two signatures differ in at most
``MOST_ERRORS`` symbols, then by the pigeonhole principle they differ in at most
``MOST_ERRORS // N_CHUNKS`` symbols of some chunk, so each chunk is entered in an index once for
each way to leave out that many of its symbols: all pairs under the distance threshold meet. Two
sets of Jaccard similarity 0.75 exceed that distance with a probability of about 1e-5.

Pairs that meet are not enumerated. First each representative is held against one hub of its
buckets, confirmed links make components, and then only pairs of different components that share a
bucket remain. Those of
one family (joined by their hubs, confirmed or not) are searched in blocks that leave only links; the others are sieved inside the join by set sizes
and by the last four bits of their symbols, and then by the distance of their signatures. Every link is confirmed on
full shingle sets. Components of a bucket that are joined already cost nothing, whatever its size,
and no pair of different components is lost.

Cost: one scan for signatures (Arrow), one shuffle of ``N_SYMBOLS`` narrow rows for each distinct
set, and a scan of the documents in candidate pairs for their sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import fresh, written
from foliant.llm.components import components
from foliant.llm.tokens import chain, mix, pieces, shingle_hashes, text_bytes, word_hashes, word_spans

SHINGLE = 5
PERCENT = 75
N_SYMBOLS, BITS, N_CHUNKS, MOST_ERRORS = 128, 16, 27, 53
#: The last four bits of each symbol, as long integers: where they differ the symbols differ.
SKETCH = tuple(f"s{i}" for i in range(N_SYMBOLS * 4 // 64))
#: Candidate documents are broadcast up to this many rows (16 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Members of a family that meet in one block.
BLOCK_MEMBERS = 512

_rng = np.random.default_rng(75)
_A = _rng.integers(1, 2**63, N_SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = _rng.integers(1, 2**63, N_SYMBOLS, dtype=np.uint64)


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = text_bytes(batch.column("text"))
    starts, stops, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, stops)
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield np.unique(shingle_hashes(words[a:b], SHINGLE))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Full MinHash values, N_SYMBOLS of them, of a set that is not empty."""
    least = np.full(N_SYMBOLS, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * _A + _C).min(axis=0))
    return mix(least)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), *((c, pa.int64()) for c in SKETCH), ("sig", pa.binary())])
    for batch in batches:
        for piece in pieces(batch, "text"):
            rows = []
            for doc_id, s in zip(piece.column("doc_id").to_pylist(), _sets(piece), strict=True):
                if not len(s):
                    rows.append((doc_id, 0, None, *(0 for _ in SKETCH), None))
                    continue
                full = signature(s)
                symbols = (full & np.uint64(0xFFFF)).astype(np.uint16)
                low = (symbols & 0xF).astype(np.uint8)
                sketch = (low[::2] << 4 | low[1::2]).view(np.int64).tolist()
                rows.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), *sketch, symbols.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _chunks() -> list[np.ndarray]:
    return np.array_split(np.arange(N_SYMBOLS), N_CHUNKS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each representative, the keys of all chunks with all sets of MOST_ERRORS // N_CHUNKS symbols left out."""
    kept = [(c, out, np.setdiff1d(chunk, out)) for c, chunk in enumerate(_chunks()) for out in combinations(chunk, MOST_ERRORS // N_CHUNKS)]
    for batch in batches:
        for at in range(0, batch.num_rows, 4000):
            part = batch.slice(at, 4000)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(len(part), N_SYMBOLS).astype(np.uint64)
            keys = np.stack([mix(chain(sig[:, own]) + np.uint64(i)) for i, (_, _, own) in enumerate(kept)], axis=1)
            ids = part.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, len(kept)))], names=["key", "rep"])


def _shingle_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            sets = [s.view(np.int64) for s in _sets(piece)]
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), lists], names=["rep", "shingles"])


def _sketch_apart(a: str, b: str) -> Column:
    """In how many symbols the last four bits differ: never more than the distance of the signatures."""

    def fours(x: Column) -> Column:
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))

    first, *rest = (fours(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH)
    return sum(rest, first)


def _symbols_apart(a: Column, b: Column) -> Column:
    """The Hamming distance of two signatures in symbols."""
    own = lambda sig, i: F.substring(sig, 2 * i + 1, F.lit(2))
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(N_SYMBOLS - 1)), lambda i: own(a, i) != own(b, i)))


def _sizes_fit(a: Column, b: Column) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * PERCENT)


def confirm(pairs: DataFrame, texts: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The pairs (u, v) whose full shingle sets have similarity PERCENT or more; texts (doc_id, text) has each of them."""
    ids = written(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "ids")
    few = ids.limit(broadcast_rows + 1).count() <= broadcast_rows
    chosen = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = written(chosen.mapInArrow(_shingle_lists, "rep long, shingles array<long>"), "sets")
    both = pairs.select("u", "v").join(sets.select(F.col("rep").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("rep").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common * 100 >= (F.size("a") + F.size("b") - common) * PERCENT).select("u", "v")


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _block_links(table: pa.Table) -> pa.Table:
    """Links to other components from the members in question (asks) to a block of the same family, by an inverted index of the block's shingles.

    A link inside what earlier links have joined is left out.
    """
    asks = table.column("asks").to_numpy()
    reps, comps = table.column("rep").to_numpy(), table.column("c").to_numpy()
    lists = table.column("shingles").combine_chunks()
    values, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    sizes, n = np.diff(bounds), len(reps)
    owner = np.repeat(np.arange(n), sizes)
    held = np.flatnonzero(~asks[owner])
    held = held[np.argsort(values[held], kind="stable")]
    ranked, posting = values[held], owner[held]
    names, label = np.unique(comps, return_inverse=True)
    parent, out = list(range(len(names))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x in np.flatnonzero(asks):
        own = values[bounds[x] : bounds[x + 1]]
        a, b = np.searchsorted(ranked, own, side="left"), np.searchsorted(ranked, own, side="right")
        runs = b - a
        where = np.repeat(a - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(int(runs.sum()))
        common = np.bincount(posting[where], minlength=n)
        near = common * 100 >= (sizes + sizes[x] - common) * PERCENT
        for y in np.flatnonzero(near & (label != label[x])):
            i, j = root(int(label[x])), root(int(label[y]))
            if i != j:
                parent[max(i, j)] = min(i, j)
                out.append((min(reps[x], reps[y]), max(reps[x], reps[y])))
    return pa.Table.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], schema=LINKS)


def within_families(members: DataFrame, texts: DataFrame, block: int = BLOCK_MEMBERS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The links (u, v) that join different components c of a family, from members (family, rep, c).

    A link between components has an end outside the largest one, so only those members ask. They are
    dealt in blocks of about ``block``, and so are all members; a task holds one block of each, so it is
    bounded whatever the family's size, and a family of m members with one outside sends m rows. Only
    links leave a task, at most one for each two components.
    """
    sizes = members.groupBy("family", "c").agg(F.count("*").alias("n"))
    ranked = sizes.groupBy("family").agg(F.max("n").alias("most"), F.sum("n").alias("m"), F.count("*").alias("parts")).where("parts > 1")
    # Of equally large components the least counts as the largest.
    largest = sizes.join(ranked, "family").where("n = most").groupBy("family").agg(F.min("c").alias("largest"), F.first("most").alias("most"), F.first("m").alias("m"))
    counted = largest.select("family", "largest", F.ceil(F.col("m") / block).cast("int").alias("blocks"), F.ceil((F.col("m") - F.col("most")) / block).cast("int").alias("askers"))
    chosen = written(members.join(counted, "family"), "groups")
    ids = chosen.select(F.col("rep").alias("doc_id")).distinct()
    few = ids.limit(broadcast_rows + 1).count() <= broadcast_rows
    sets = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(_shingle_lists, "rep long, shingles array<long>")
    deal = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    held = F.struct(F.lit(False).alias("asks"), every(F.col("askers")).alias("i"), F.array(deal(F.col("blocks"))).alias("j"))
    asking = F.struct(F.lit(True).alias("asks"), F.array(deal(F.col("askers"))).alias("i"), every(F.col("blocks")).alias("j"))
    sides = F.when(F.col("c") == F.col("largest"), F.array(held)).otherwise(F.array(held, asking))
    rows = chosen.join(sets, "rep").select("family", "rep", "c", "shingles", F.explode(sides).alias("s"))
    rows = rows.select("family", "rep", "c", "shingles", "s.asks", F.explode("s.i").alias("i"), "s.j").withColumn("j", F.explode("j"))
    return rows.groupBy("family", "i", "j").applyInArrow(_block_links, "u long, v long")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row of docs.

    Keys are long integers that identify rows. Null and empty texts have no shingles and link with
    nothing; rows with a null key link with nothing and are kept. Texts shorter than five words are
    one shingle. An empty table gives an empty result.
    """
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = written(texts.mapInArrow(_signatures, f"doc_id long, n long, fp binary, {', '.join(f'{c} long' for c in SKETCH)}, sig binary"), "signatures")
    usable = every.where("fp IS NOT NULL AND doc_id IS NOT NULL")
    reps = written(usable.groupBy("fp").agg(F.min(F.struct("doc_id", "n", *SKETCH, "sig")).alias("x")).select("fp", "x.*"), "reps")
    small = reps.select(F.col("doc_id").alias("rep"), "n", *SKETCH)

    # Buckets of one member go; neighbours in a bucket tell, so no bucket is held.
    keys = reps.select("doc_id", "sig").mapInArrow(_keys, "key long, rep long")
    bucket = Window.partitionBy("key").orderBy("rep")
    met = keys.select("key", "rep", F.lag("rep").over(bucket).alias("before"), F.lead("rep").over(bucket).alias("after"))
    met = written(met.where("before IS NOT NULL OR after IS NOT NULL").select("key", "rep"), "met")

    # Round 1: each representative against one hub. The members that meet most others are hubs of their
    # buckets, and of its hubs a representative takes the one it meets most often. An original that
    # was copied with edits is such a hub, nearer to each copy than the copies are to each other.
    degree = met.join(met.groupBy("key").agg(F.count("*").alias("size")), "key").groupBy("rep").agg(F.sum(F.col("size") - 1).alias("degree"))
    top = Window.partitionBy("key").orderBy(F.col("degree").desc(), "rep").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hubs = met.join(written(degree, "degree"), "rep").select("rep", F.first("rep").over(top).alias("hub"))
    often = hubs.where("hub <> rep").groupBy("rep", "hub").agg(F.count("*").alias("times"))
    first = often.groupBy("rep").agg(F.max(F.struct("times", (-F.col("hub")).alias("less"))).alias("x")).select("rep", (-F.col("x.less")).alias("hub"))
    a, b = small.alias("a"), small.alias("b")
    sieve = _sizes_fit(F.col("a.n"), F.col("b.n")) & (_sketch_apart("a", "b") <= MOST_ERRORS)
    tried = first.join(a, F.col("a.rep") == first["rep"]).join(b, F.col("b.rep") == first["hub"]).where(sieve)
    tried = written(tried.select(F.least("hub", first["rep"]).alias("u"), F.greatest("hub", first["rep"]).alias("v")).distinct(), "tried")
    stars = components(confirm(tried, texts), "round1")

    # Round 2: pairs of different components that meet, first those of one family, then the others.
    labelled = met.select("key", "rep").join(stars.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    mixed = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    # A family: representatives joined by their hubs, confirmed or not, if sizes and sketches fit.
    family = components(tried, "families").select(F.col("node").alias("rep"), F.col("component").alias("family"))
    open_ = labelled.join(mixed, "key").join(small, "rep").join(family, "rep", "left").withColumn("family", F.coalesce("family", "rep"))
    open_ = written(open_.select("key", "rep", "c", "family", "n", *SKETCH), "open")
    inside = within_families(open_.select("family", "rep", "c").distinct(), texts)
    x, y = open_.alias("a"), open_.alias("b")
    across = x.join(y, (F.col("a.key") == F.col("b.key")) & (F.col("a.c") < F.col("b.c")) & (F.col("a.family") != F.col("b.family")) & sieve)
    across = across.select(F.least("a.rep", "b.rep").alias("u"), F.greatest("a.rep", "b.rep").alias("v")).distinct().join(tried, ["u", "v"], "left_anti")
    across = written(across, "across")
    sigs = reps.select(F.col("doc_id").alias("rep"), "sig")
    apart = across.join(sigs.select(F.col("rep").alias("u"), F.col("sig").alias("a")), "u").join(sigs.select(F.col("rep").alias("v"), F.col("sig").alias("b")), "v").where(_symbols_apart(F.col("a"), F.col("b")) <= MOST_ERRORS)
    more = confirm(written(apart.select("u", "v"), "near"), texts).union(inside)
    joined = components(stars.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more), "round2")

    by_class = reps.select("fp", F.col("doc_id").alias("rep")).join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    own = every.select("doc_id", "n", "fp").join(by_class, "fp", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return own.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: that of the least key."""
    gone = linked(docs, key, text).where("NOT kept").select(F.col(key).alias(fresh(docs, "gone")))
    return docs.join(gone, docs[key] == gone[gone.columns[0]], "left_anti")
