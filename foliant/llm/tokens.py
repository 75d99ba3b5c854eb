"""Vectorised words of Arrow text columns, for operators that run in Python.

Texts are handled as one array of UTF-8 bytes in pieces of bounded size, so memory does not grow
with a batch. Word hashes have 64 bits and are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2_000_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(int(_rng.integers(1, 2**63)) | 1)
#: Lower-case A-Z only; every other byte stands for itself.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have at most about ``most`` bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        base = int(total[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of the texts (null: empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, first): byte spans of all words, and the number of the first word of each text and one more."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    begin[cuts] = inside[cuts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cuts - 1] = inside[cuts - 1]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    value = _BYTE[_LOWER[raw]]
    sizes = stops - starts
    place = np.arange(len(raw), dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else np.concatenate([np.full(starts[0], 0), np.repeat(starts, np.diff(np.append(starts, len(raw))))])
    power = np.ones(int(sizes.max()) + 1, np.uint64)
    power[1:] = np.cumprod(np.full(int(sizes.max()), _STEP, np.uint64))
    value *= power[np.clip(place, 0, len(power) - 1)]
    value[_SPACE[raw]] = 0
    return mix(np.add.reduceat(value, starts) + sizes.astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words; fewer words are one run."""
    n = len(words)
    if not n:
        return words
    if n < k:
        return mix(chain(words[None, :]) + np.uint64(n))
    return mix(chain(np.lib.stride_tricks.sliding_window_view(words, k)) + np.uint64(k))


def chain(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        out = (out + rows[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out
