"""Katz backoff language model of any order, counted into partitioned tables and scored from them.

P(w | h) is d(c) c / c(h) for an n-gram seen c times in training, d the Good-Turing discount of counts
up to ``MOST_DISCOUNTED``, and alpha(h) P(w | h') for one not seen, h' being h without its first word.
alpha(h) is the mass that the seen n-grams of h leave, divided by the mass that P(. | h') gives to the
words not seen after h, so each distribution adds up to 1. A context of which no n-gram is discounted
would leave nothing; its n-grams are divided by c(h) + 1. P(w) is (c + 1) / (N + V + 1), the last share
being that of all unknown words. A context that training has not seen backs off with weight 1.

The model is four kinds of counts in tables of the shared folder, partitioned by hash: words, n-grams
of each order, contexts of each order. Texts are laid down once as blocks of numbered words. A block
asks the tables about its distinct n-grams, packed, one message for each partition, and gets packed
answers in the same order; then it scores its tokens, each from the highest order down. A message that
also carries training counts makes the table while it asks, so counting and scoring share one shuffle.

Work is dealt by the hash of the whole n-gram and combined in the block, so a word or pair that holds a
third of all tokens is one entry of a message for each block, and no task holds the followers of a
word. Sums of contexts are added up in blocks too: the partition names one owner block for each n-gram,
which counts it for its context.

Cost for one order: a scan of the texts, then three narrow shuffles by n-gram, context and block, with
about 6 bytes for each distinct n-gram of a block and 3 for each token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, written
from foliant.llm.tokens import _SPACE, PIECE_BYTES, mix, pieces, text_bytes, word_hashes, word_spans

#: Words of an n-gram.
ORDER = 2
#: Good-Turing discounts counts 1 to this.
MOST_DISCOUNTED = 5
#: Tokens of a block, of a partition of the tables, and bytes of a text that are read at a time, about.
BLOCK_TOKENS, PART_TOKENS, SEGMENT_BYTES = 1_500_000, 1_000_000, 4_000_000
LEAST_PARTS = 48
#: Hashes that stand for the end token and for what is before a text.
END, BEGIN = np.uint64(0x656E64), np.uint64(0x626567)
#: block numbers of rows that are no answer to a block.
TABLE = -1
#: Rows have an n-gram order, or that of a context's n-grams plus CONTEXT.
CONTEXT = 100

MESSAGE = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
MESSAGE_DDL = "kind int, part int, block long, payload binary"
_CLASSES = [f"n{i}" for i in range(1, MOST_DISCOUNTED + 2)]
ANSWER_DDL = MESSAGE_DDL + ", items long, tokens long, " + ", ".join(f"{c} long" for c in _CLASSES)
ANSWER = pa.schema([*MESSAGE, ("items", pa.int64()), ("tokens", pa.int64()), *((c, pa.int64()) for c in _CLASSES)])


def _narrow(a: np.ndarray) -> np.ndarray:
    if a.dtype == np.float64:
        return a
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 2**8 else np.uint16 if most < 2**16 else np.uint32 if most < 2**32 else np.uint64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, each as narrow as it can be, their bytes by place so that they compress."""
    out = []
    for a in map(_narrow, arrays):
        planes = np.ascontiguousarray(np.frombuffer(a.tobytes(), np.uint8).reshape(-1, a.itemsize).T).tobytes() if len(a) else b""
        out.append(len(a).to_bytes(8, "little") + a.itemsize.to_bytes(1, "little") + a.dtype.kind.encode() + planes)
    body = b"".join(out)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(payload: pa.Buffer | bytes) -> list[np.ndarray]:
    view = pa.py_buffer(payload)
    body = pa.decompress(view.slice(8), int.from_bytes(view.slice(0, 8).to_pybytes(), "little"), codec="zstd", asbytes=True)
    at, out = 0, []
    while at < len(body):
        n, size, kind = int.from_bytes(body[at : at + 8], "little"), body[at + 8], chr(body[at + 9])
        planes = np.frombuffer(body, np.uint8, n * size, at + 10).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"{kind}{size}").ravel() if n else np.zeros(0, f"{kind}{size}"))
        at += 10 + n * size
    return out


def _gaps(sorted_hashes: np.ndarray) -> np.ndarray:
    return np.diff(sorted_hashes, prepend=np.uint64(0))


def _hashes(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps.astype(np.uint64), dtype=np.uint64)


def _cuts(sorted_hashes: np.ndarray, parts: int) -> list[int]:
    """Where the hashes of each partition begin: partitions are equal ranges of hashes."""
    edges = [np.uint64((2**64 * p) // parts) for p in range(parts)]
    return [*np.searchsorted(sorted_hashes, np.array(edges, np.uint64)).tolist(), len(sorted_hashes)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# Blocks of numbered words


def _segments(raw: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, bool]]:
    """A text in runs of about most bytes that end between words; the flag marks the last."""
    at = 0
    while len(raw) - at > most:
        cut = at + most
        while cut < len(raw):
            spaces = np.flatnonzero(_SPACE[raw[cut : cut + 65_536]])
            if len(spaces):
                cut += int(spaces[0])
                break
            cut += 65_536
        if cut >= len(raw):
            break
        yield raw[at:cut], False
        at = cut
    yield raw[at:], True


def _lay(order: int, block_tokens: int, segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(kind, part, block, payload) of the blocks of a task; a text longer than segment_bytes may go over into the next block."""
        task, rows_seen, blocks, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal blocks
            words = np.concatenate([w for w, *_ in held])
            before = np.concatenate([b for _, b, *_ in held])
            vocabulary, index, times = np.unique(np.concatenate([words, before]), return_inverse=True, return_counts=True)
            by_rank = np.argsort(-times, kind="stable")
            rank = np.empty(len(by_rank), np.uint32)
            rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
            index = rank[index]
            facts = [np.array([h[i] for h in held], np.int64).view(np.uint64) for i in range(2, 8)]
            row = (0, 0, (task << 32) + blocks, _pack(vocabulary[by_rank], index[: len(words)], index[len(words) :], *facts))
            tokens = len(words)
            held.clear()
            blocks += 1
            return _batch([(*row, len(vocabulary), tokens, *(0 for _ in _CLASSES))], ANSWER)

        for batch in batches:
            for piece in pieces(batch, "text", min(PIECE_BYTES, segment_bytes)):
                raw, offsets = text_bytes(piece.column("text"))
                keys, trains = piece.column("key").to_pylist(), piece.column("train").to_pylist()
                if len(piece) == 1 and len(raw) > segment_bytes:
                    runs = [(part, np.array([0, len(part)]), [0], [last]) for part, last in _segments(raw, segment_bytes)]
                else:
                    runs = [(raw, offsets, range(len(piece)), [True] * len(piece))]
                before, seg = np.full(order - 1, BEGIN), 0
                for part, bounds, own, lasts in runs:
                    starts, stops, first = word_spans(part, bounds)
                    words = word_hashes(part, starts, stops)
                    for i, a, b, last in zip(own, first[:-1].tolist(), first[1:].tolist(), lasts, strict=True):
                        if len(runs) == 1:
                            before, seg = np.full(order - 1, BEGIN), 0
                        tokens = np.append(words[a:b], END) if last else words[a:b]
                        held.append((tokens, before, len(tokens), keys[i] or 0, keys[i] is None, trains[i], (task << 40) + rows_seen + i, 2 * seg + last))
                        before, seg = np.concatenate([before, words[a:b]])[len(before) + (b - a) - (order - 1) :], seg + 1
                        size += len(tokens)
                        if size > block_tokens:
                            yield flush()
                            size = 0
                rows_seen += len(piece)
        if held:
            yield flush()

    return run


class Block:
    """The tokens of some texts, with the hashes of the n-grams that end at each."""

    def __init__(self, payload: pa.Buffer | bytes, order: int) -> None:
        vocabulary, index, before, sizes, *facts = _unpack(payload)
        self.sizes = sizes.astype(np.int64)
        self.key, self.key_null, self.train, self.uid, self.place = (f.astype(np.uint64).view(np.int64) for f in facts)
        n, lead = len(self.sizes), order - 1
        self.vocabulary, self.index = vocabulary, index
        ends = np.cumsum(self.sizes)
        # Each text with the words before it: tokens stand at ``at``.
        self.at = np.arange(len(index)) + np.repeat(np.arange(1, n + 1) * lead, self.sizes)
        run = np.empty(len(index) + n * lead, np.uint64)
        run[self.at] = vocabulary[index]
        if lead:
            run[(np.repeat(ends - self.sizes + np.arange(n) * lead, lead) + np.tile(np.arange(lead), n))] = vocabulary[before]
        self.starts = ends - self.sizes
        self.learned = np.repeat(self.train, self.sizes).astype(bool)
        self.grams = [None, mix(run)]
        for _ in range(2, order + 1):
            longer = np.zeros(len(run), np.uint64)
            longer[1:] = mix(self.grams[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + run[1:])
            self.grams.append(longer)

    def of(self, k: int) -> np.ndarray:
        """The hash of the n-gram of order k that ends at each token."""
        return self.grams[k][self.at]

    def context(self, k: int) -> np.ndarray:
        """The hash of the k - 1 words before each token."""
        return self.grams[k - 1][self.at - 1]


def _split(kind: int, block: int, hashes: np.ndarray, columns: list[np.ndarray], parts: int) -> Iterator[tuple]:
    """Messages about sorted distinct hashes, one for each partition that has any."""
    cuts = _cuts(hashes, parts)
    for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            yield (kind, p, block, _pack(_gaps(hashes[a:b]), *(c[a:b] for c in columns)))


def _ask_grams(order: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What blocks tell and ask about their n-grams: hashes and how often training has them."""
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                block = Block(payload.as_buffer(), order)
                for k in range(1, order + 1):
                    own, index = np.unique(block.of(k), return_inverse=True)
                    counts = np.bincount(index[block.learned], minlength=len(own))
                    yield _batch(list(_split(k, number, own, [counts], parts)), MESSAGE)

    return run


def _grouped(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal values of some columns, as ((values), [(kind, part, block, payload)])."""
    now, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in by]
        kinds, parts, blocks = (batch.column(c).to_pylist() for c in ("kind", "part", "block"))
        for i, value in enumerate(zip(*columns, strict=True)):
            if value != now:
                if held:
                    yield now, held
                now, held = value, []
            held.append((kinds[i], parts[i], blocks[i], batch.column("payload")[i].as_buffer()))
    if held:
        yield now, held


def _merge(rows: list[tuple]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[int], np.ndarray]:
    """(distinct sorted hashes, summed columns, place of each message's entries among them, message bounds, first entry of each) of the messages to a partition."""
    unpacked = [_unpack(r[3]) for r in rows]
    bounds = np.concatenate([[0], np.cumsum([len(u[0]) for u in unpacked])]).tolist()
    hashes = np.concatenate([_hashes(u[0]) for u in unpacked])
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    begins = np.flatnonzero(new)
    place = np.empty(len(hashes), np.int64)
    place[order] = np.cumsum(new) - 1
    sums = []
    for i in range(1, len(unpacked[0])):
        column = np.concatenate([u[i] for u in unpacked]).astype(np.int64)
        sums.append(np.add.reduceat(column[order], begins))
    return ranked[begins], sums, place, bounds, order[begins]


def _answer_grams(tables: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of n-grams, to each block that asked and, if tables, as a table. Odd answers make the block the owner of the n-gram."""
        for (_, _), rows in _grouped(batches, "part", "kind"):
            kind, part, zeros = rows[0][0], rows[0][1], [0] * (2 + len(_CLASSES))
            hashes, (counts,), place, bounds, first = _merge(rows)
            answer = 2 * counts[place]
            answer[first] += 1
            out = [(*r[:3], _pack(answer[a:b]), *zeros) for r, a, b in zip(rows, bounds[:-1], bounds[1:], strict=True) if r[2] >= 0]
            if tables:
                held = counts > 0
                classes = np.bincount(np.minimum(counts[held], MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)[1 : MOST_DISCOUNTED + 2]
                out.append((kind, part, TABLE, _pack(_gaps(hashes[held]), counts[held]), int(held.sum()), int(counts.sum()), *classes.tolist()))
            yield _batch(out, ANSWER)

    return run


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, and the number among them of each, in few bytes."""
    own, index = np.unique(hashes, return_inverse=True)
    return own, index.astype(np.int32)


def _facts(block: Block, answers: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, owned) of each distinct n-gram of order k, and the number of the n-gram of each token."""
    _, index = _numbered(block.of(k))
    said = np.concatenate([_unpack(a[3])[0] for a in answers if a[0] == k])
    return (said >> 1).astype(np.int64), (said & 1).astype(bool), index


def _token_of(index: np.ndarray, n: int) -> np.ndarray:
    """A token that has each n-gram."""
    out = np.empty(n, np.int32)
    out[index] = np.arange(len(index), dtype=np.int32)
    return out


def _ask_contexts(order: int, parts: int, learning: bool):
    k_ = MOST_DISCOUNTED

    def classes(counts: np.ndarray, where: np.ndarray, n: int) -> list[np.ndarray]:
        out = [np.bincount(where[counts == i], minlength=n) for i in range(1, k_ + 1)]
        big = counts > k_
        return [*out, np.bincount(where[big], counts[big], n).astype(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What blocks tell and ask about contexts: by count of the n-grams that they own, how many follow; and what the lower order gives to these."""
        for (number,), rows in _grouped(batches, "block"):
            block, answers = Block(rows[0][3], order), rows[1:]
            lower, _, lower_of = _facts(block, answers, 1)
            for k in range(2, order + 1):
                counts, owned, index = _facts(block, answers, k)
                hashes, context = _numbered(block.context(k))
                n, mine = len(hashes), np.flatnonzero(owned & (counts > 0) & learning)
                token = _token_of(index, len(counts))[mine]
                where = context[token]
                below = lower[lower_of[token]]
                beneath = [np.bincount(where, below + 1, n).astype(np.int64)] if k == 2 else classes(below, where, n)
                yield _batch(list(_split(CONTEXT + k, number, hashes, [*classes(counts[mine], where, n), *beneath], parts)), MESSAGE)
                lower, lower_of = counts, index

    return run


def _used(classes: list[np.ndarray], discount: list[float]) -> np.ndarray:
    """Discounted counts added up, from the numbers of n-grams by count and the sum of the higher counts."""
    return sum(((i + 1) * d * n for i, (d, n) in enumerate(zip(discount, classes, strict=False))), classes[MOST_DISCOUNTED].astype(np.float64))


def _answer_contexts(discount: dict[int, list[float]], tables: bool):
    k_ = MOST_DISCOUNTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(denominator, mass left, numerator of the lower order's mass) of contexts; a denominator of 0 marks one not seen."""
        for (_, _), rows in _grouped(batches, "part", "kind"):
            kind, part, zeros = rows[0][0], rows[0][1], [0] * (2 + len(_CLASSES))
            k = kind - CONTEXT
            hashes, sums, place, bounds, _ = _merge(rows)
            own, beneath = sums[: k_ + 1], sums[k_ + 1 :]
            c = sum(((i + 1) * n for i, n in enumerate(own[:k_])), own[k_])
            whole = sum((n for n, d in zip(own, discount[k], strict=False) if d < 1), np.zeros(len(c), np.int64)) == 0
            below = np.where(c > 0, c + whole, 0)
            left = np.where(c > 0, 1 - _used(own, discount[k]) / np.maximum(below, 1), 1.0)
            numerator = beneath[0].astype(np.float64) if k == 2 else _used(beneath, discount[k - 1])
            out = [(*r[:3], _pack(below[place[a:b]], left[place[a:b]], numerator[place[a:b]]), *zeros) for r, a, b in zip(rows, bounds[:-1], bounds[1:], strict=True) if r[2] >= 0]
            if tables:
                held = c > 0
                out.append((kind, part, TABLE, _pack(_gaps(hashes[held]), *(s[held] for s in sums)), int(held.sum()), int(c.sum()), *(0 for _ in _CLASSES)))
            yield _batch(out, ANSWER)

    return run


SCORE_DDL = "uid long, seg int, last boolean, key long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _score(order: int, n: int, v: int, discount: dict[int, list[float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the scores of each text's tokens in the block, token by token from the highest order down."""
        for _, rows in _grouped(batches, "block"):
            block, answers = Block(rows[0][3], order), rows[1:]
            # Of each order: counts and the number of each token's n-gram; of contexts the denominator, alpha and the number.
            count, gram, below, alpha, context = {}, {}, {1: np.array([n + v + 1.0])}, {}, {1: np.zeros(len(block.at), np.int8)}
            for k in range(1, order + 1):
                count[k], _, gram[k] = _facts(block, answers, k)
                if k > 1:
                    _, context[k] = _numbered(block.context(k))
                    said = [_unpack(a[3]) for a in answers if a[0] == CONTEXT + k]
                    denominator, left, numerator = (np.concatenate([s[i] for s in said]) for i in range(3))
                    below[k] = denominator.astype(np.float64)
                    # Neither is 0: a context leaves mass, and unknown words have a share that is never seen.
                    shorter = below[k - 1][context[k - 1][_token_of(context[k], len(denominator))]]
                    free = 1 - numerator / np.maximum(shorter, 1)
                    alpha[k] = np.log10(np.where(denominator > 0, left / np.where(denominator > 0, free, 1.0), 1.0))
            log_base = np.log10((count[1] + 1) / (n + v + 1))
            rate = {k: np.array([0.0, *discount[k], 1.0]) for k in range(2, order + 1)}
            log_used = {k: np.log10(np.where(c > 0, rate[k][np.minimum(c, MOST_DISCOUNTED + 1)] * c, 1.0)) for k, c in count.items() if k > 1}
            log_below = {k: np.log10(np.maximum(b, 1)) for k, b in below.items() if k > 1}

            def log_p(k: int, at: np.ndarray) -> np.ndarray:
                """log10 P of the tokens at some places by order k."""
                own = gram[k][at]
                if k == 1:
                    return log_base[own]
                out = log_used[k][own] - log_below[k][context[k][at]]
                unseen = np.flatnonzero(count[k][own] == 0)
                out[unseen] = alpha[k][context[k][at[unseen]]] + log_p(k - 1, at[unseen])
                return out

            # A segment without a token, of spaces only, has sums of 0.
            some = np.flatnonzero(block.sizes > 0)

            def summed(x: np.ndarray) -> np.ndarray:
                out = np.zeros(len(block.sizes), x.dtype)
                if len(some):
                    out[some] = np.add.reduceat(x, block.starts[some])
                return out

            columns = [block.uid, (block.place >> 1).astype(np.int32), (block.place & 1).astype(bool), block.key, block.train == 0, block.sizes, summed((count[1] > 0)[gram[1]].astype(np.int64)), summed(log_base[gram[1]]), summed(log_p(order, np.arange(len(block.at), dtype=np.int32)))]
            names = [c.strip().split(" ")[0] for c in SCORE_DDL.split(",")]
            arrays = [pa.array(c, mask=block.key_null.astype(bool)) if name == "key" else pa.array(c) for name, c in zip(names, columns, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def discounts(of_counts: list[int]) -> list[float]:
    """d(1) to d(k) by Katz's formula from the numbers of n-grams seen 1 to k+1 times.

    If they are not rising inside (0, 1), as happens with few n-grams, the numbers are first smoothed by
    a line through their logarithms (Gale and Sampson); if that does not fall steeply enough, nothing
    is discounted.
    """
    k = MOST_DISCOUNTED

    def katz(n: list[float]) -> list[float]:
        whole = (k + 1) * n[k] / n[0]
        return [((r + 1) * n[r] / (r * n[r - 1]) - whole) / (1 - whole) for r in range(1, k + 1)] if whole != 1 else [0.0]

    def usable(d: list[float]) -> bool:
        return all(0 < x < 1 for x in d) and d == sorted(d)

    if all(of_counts) and usable(raw := katz([float(n) for n in of_counts])):
        return raw
    points = [(math.log(r), math.log(n)) for r, n in enumerate(of_counts, 1) if n]
    if len(points) > 1:
        slope = float(np.polyfit(*zip(*points, strict=True), 1)[0])
        if slope < -1 and usable(smooth := katz([r**slope for r in range(1, k + 2)])):
            return smooth
    return [1.0] * k


@dataclass
class Model:
    """A counted model: its tables in the shared folder, and the few numbers that belong to all."""

    order: int
    parts: int
    grams: DataFrame  # MESSAGE rows with block TABLE: hashes and counts by order and partition
    contexts: DataFrame  # the same of contexts, with sums of their n-grams
    n: int
    v: int
    discount: dict[int, list[float]]

    def ngrams(self) -> DataFrame:
        """(order, gram, count): a row for each n-gram, from the packed table."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload"), strict=True):
                    gaps, counts = _unpack(payload.as_buffer())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gaps), kind, np.int32)), pa.array(_hashes(gaps).view(np.int64)), pa.array(counts.astype(np.int64))], names=["order", "gram", "count"])

        return self.grams.mapInArrow(rows, "order int, gram long, count long")


def _laid(docs: DataFrame, train: Column, key: str, text: str, order: int, block_tokens: int, segment_bytes: int) -> DataFrame:
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return written(own.mapInArrow(_lay(order, block_tokens, segment_bytes), ANSWER_DDL), "katz_blocks")


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.select("kind", "part", "block", "payload").repartition(parts, "part").sortWithinPartitions("part", "kind", "block")


def _met(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Each block, with kind 0, and then the answers to it in order of kind and partition."""
    rows = blocks.select("kind", "part", "block", "payload")
    for more in answers:
        rows = rows.unionByName(more.select("kind", "part", "block", "payload").where(F.col("block") != TABLE))
    return rows.repartition("block").sortWithinPartitions("block", "kind", "part")


def _resolved(blocks: DataFrame, order: int, parts: int, model: Model | None) -> tuple[Model, DataFrame, DataFrame]:
    """(model, answers about n-grams, answers about contexts) for blocks; without a model the blocks make one."""
    new = model is None
    asked = blocks.mapInArrow(_ask_grams(order, parts), MESSAGE_DDL)
    grams = written(_dealt(asked if new else asked.unionByName(model.grams.select(*MESSAGE.names)), parts).mapInArrow(_answer_grams(new), ANSWER_DDL), "katz_grams")
    if new:
        rows = grams.where(F.col("block") == TABLE).groupBy("kind").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), *(F.sum(c).alias(c) for c in _CLASSES)).collect()
        by_order = {r["kind"]: r for r in rows}
        discount = {k: discounts([by_order[k][c] for c in _CLASSES]) if k in by_order else [1.0] * MOST_DISCOUNTED for k in range(2, order + 1)}
        n, v = (by_order[1]["tokens"], by_order[1]["items"]) if 1 in by_order else (0, 0)
    else:
        discount, n, v = model.discount, model.n, model.v
    asked = _met(blocks, grams).mapInArrow(_ask_contexts(order, parts, new), MESSAGE_DDL)
    contexts = written(_dealt(asked if new else asked.unionByName(model.contexts.select(*MESSAGE.names)), parts).mapInArrow(_answer_contexts(discount, new), ANSWER_DDL), "katz_contexts")
    if new:
        model = Model(order, parts, grams.where(F.col("block") == TABLE), contexts.where(F.col("block") == TABLE), n, v, discount)
    return model, grams, contexts


def _scored(blocks: DataFrame, model: Model, grams: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    each = written(_met(blocks, grams, contexts).mapInArrow(_score(model.order, model.n, model.v, model.discount), SCORE_DDL), "katz_scores")
    sums = ["n_tokens", "n_known", "base", "score"]
    alone = (F.col("seg") == 0) & F.col("last")
    # The segments of a long text, added up in their order so that reruns agree to the last bit.
    held = each.where(~alone).groupBy("uid").agg(F.first("key").alias("key"), F.first("held_out").alias("held_out"), F.sort_array(F.collect_list(F.struct("seg", *sums))).alias("s"))

    def total(c: str) -> Column:
        return F.aggregate("s", F.lit(0).cast(each.schema[c].dataType), lambda a, x: a + x[c]).alias(c)

    rows = each.where(alone).select("key", "held_out", *sums).unionByName(held.select("key", "held_out", *map(total, sums)))
    return rows.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def _parts(blocks: DataFrame, part_tokens: int) -> int:
    return max(LEAST_PARTS, math.ceil((blocks.agg(F.sum("tokens")).first()[0] or 0) / part_tokens))


def scored(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, part_tokens: int = PART_TOKENS, block_tokens: int = BLOCK_TOKENS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs; train marks the rows to learn from.

    A null text is empty and has only its end token. A null or repeated key is a row like any other;
    equal rows get equal scores, and each counts in training. Without training rows all is unknown.
    Texts of any length are read in segments. An empty table gives an empty result.
    """
    blocks = _laid(docs, train, key, text, order, block_tokens, segment_bytes)
    model, grams, contexts = _resolved(blocks, order, _parts(blocks, part_tokens), None)
    out = _scored(blocks, model, grams, contexts, key)
    discard(blocks, grams, contexts)
    return out


def trained(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, part_tokens: int = PART_TOKENS, block_tokens: int = BLOCK_TOKENS, segment_bytes: int = SEGMENT_BYTES) -> Model:
    """The model of all rows of docs; its tables stay in the shared folder. An empty table gives an empty model."""
    blocks = _laid(docs, F.lit(True), key, text, order, block_tokens, segment_bytes)
    return _resolved(blocks, order, _parts(blocks, part_tokens), None)[0]


def scores(model: Model, docs: DataFrame, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """What scored() gives, for texts that the model has not learned from: its tables answer, none is counted."""
    blocks = _laid(docs, F.lit(False), key, text, model.order, block_tokens, segment_bytes)
    return _scored(blocks, *_resolved(blocks, model.order, model.parts, model), key)
