"""Language identification by a linear-chain conditional random field over the words of a text.

Emissions are sums of learned weights of a word's features: the word itself (lexicon), and its
n-grams of 2 to 4 bytes with the spaces around it, which hold its affixes. Transitions between
languages are learned with them, from texts cut into segments and strung together, so that the
model sees code-switching. Forward-backward gives each word its posterior; a document's language is
the label with the highest mean posterior.

Fitting takes a bounded sample: about ``SAMPLE`` whole texts of each language, chosen by a hash of
the key, none longer than ``SAMPLE_BYTES``. It follows the exact gradient of the likelihood, with word
and pair marginals from forward-backward. Prediction runs over whole texts of any length: texts
are cut into chunks, the transfer matrices of chunks are chained, and the chunks are run again from
both ends, which is exact and works on all chunks of a batch at once. A text longer than
``SEGMENT_BYTES`` is gone through twice in segments, of which only transfer matrices are held. No
shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import WORD, hash60
from foliant.llm.tokens import pieces, word_hashes, word_spans

SAMPLE, SAMPLE_BYTES, MOST_LABELS = 120, 40_000, 200
GRAMS, GRAM_BUCKETS, WORD_BUCKETS = (2, 3, 4), 1 << 16, 1 << 17
CHUNK = 32
#: Bytes that are scored at a time with up to four labels; fewer with more labels, by the square of their number.
SEGMENT_BYTES = 1_000_000
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass
class Crf:
    labels: list[str]
    grams: np.ndarray  # GRAMS x GRAM_BUCKETS x labels
    words: np.ndarray  # WORD_BUCKETS x labels
    transitions: np.ndarray  # labels x labels


def features(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of the n-grams that start at each byte, word buckets, starts, stops, number of the first word of each text)."""
    coded = [f" {t.lower()} ".encode() for t in texts]
    raw = np.frombuffer(b"".join(coded), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
    starts, stops, first = word_spans(raw, offsets)
    rank, grams = raw.astype(np.uint32), []
    for n in GRAMS:
        rank = rank[: len(raw) - n + 1] * np.uint32(0x01000193) ^ raw[n - 1 :]
        grams.append(((rank * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64) if len(rank) else np.zeros(0, np.int64))
    word = (word_hashes(raw, starts, stops) >> np.uint64(47)).astype(np.int64)
    return grams, word, starts, stops, first


def _ranges(n: int, size: int, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a word begin at its leading space and end at its trailing one."""
    low = np.clip(starts - 1, 0, size)
    return low, np.maximum(np.clip(stops - n + 2, 0, size), low)


def emissions(model: Crf, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(score of each label for each word, number of the first word of each text and one more)."""
    grams, word, starts, stops, first = features(texts)
    out = model.words[word].astype(np.float64)
    for i, n in enumerate(GRAMS):
        low, high = _ranges(n, len(grams[i]), starts, stops)
        total = np.zeros(len(grams[i]) + 1)
        for j in range(len(model.labels)):  # one label at a time, so memory does not grow with bytes times labels
            np.cumsum(model.grams[i][:, j][grams[i]], dtype=np.float64, out=total[1:])
            out[:, j] += total[high] - total[low]
    return out, first


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.max(axis=tuple(range(1, x.ndim)), keepdims=True, initial=0.0), 1e-300)


def _weights(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=1, keepdims=True))


def _step_of(transitions: np.ndarray) -> np.ndarray:
    return np.exp(transitions - transitions.max())


def transfer_of(scores: np.ndarray, transitions: np.ndarray, begins: bool) -> np.ndarray:
    """The product of the transfer matrices of a run of words, scaled; the first word of a text has no transition."""
    emit, step = _weights(scores), _step_of(transitions)
    n, k = scores.shape
    parts = np.empty((n, k, k))
    parts[:] = step[None] * emit[:, None, :]
    if begins:
        parts[0] = np.diag(emit[0])
    while len(parts) > 1:  # neighbours are multiplied in pairs
        odd = parts[-1:] if len(parts) % 2 else parts[:0]
        parts = np.concatenate([_unit(parts[0 : len(parts) - len(odd) : 2] @ parts[1::2]), odd])
    return parts[0]


def posteriors(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, entering: np.ndarray | None = None, leaving: np.ndarray | None = None, pairs: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """The posterior of each label for each word; first: the number of the first word of each text and one more.

    With entering and leaving, the words are a run inside a text, and these are the forward state
    before and the backward state after it (entering None: the text begins). With pairs, also the
    expected number of each transition, added up over all texts.
    """
    n, k = scores.shape
    if not n:
        return (scores, np.zeros((k, k))) if pairs else scores
    size = np.diff(first)
    chunks = -(-size // CHUNK)
    chunk_of = np.concatenate([[0], np.cumsum(chunks)])
    local = np.arange(n) - np.repeat(first[:-1], size)
    at = np.repeat(chunk_of[:-1], size) * CHUNK + local
    total = int(chunk_of[-1])
    held = np.zeros((total * CHUNK, k))
    held[at] = _weights(scores)
    valid = np.zeros(total * CHUNK, bool)
    valid[at] = True
    emit, valid = held.reshape(total, CHUNK, k), valid.reshape(total, CHUNK)
    step = _step_of(transitions)
    begins = np.zeros(total, bool)
    if entering is None:
        begins[chunk_of[:-1][chunks > 0]] = True

    def moved(state: np.ndarray, t: int) -> np.ndarray:
        """The state before word t is taken in; the first word of a text has no transition."""
        return np.where(begins.reshape(-1, *[1] * (state.ndim - 1)), state, state @ step) if t == 0 else state @ step

    transfer = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(CHUNK):
        on = valid[:, t]
        transfer[on] = _unit((moved(transfer, t)[on]) * emit[on, t][:, None, :])
    into, back = np.ones((total, k)), np.ones((total, k))
    order = np.argsort(-chunks, kind="stable")
    base, count = chunk_of[:-1][order], chunks[order]
    if entering is not None:
        into[0] = entering
    if leaving is not None:
        back[-1] = leaving
    for j in range(int(chunks.max(initial=0)) - 1):
        live = base[: np.searchsorted(-count, -(j + 1), side="left")] + j
        into[live + 1] = _unit(np.einsum("ni,nij->nj", into[live], transfer[live]))
    for j in range(int(chunks.max(initial=0)) - 1, 0, -1):
        live = base[: np.searchsorted(-count, -j, side="left")] + j
        back[live - 1] = _unit(np.einsum("nij,nj->ni", transfer[live], back[live]))
    forward, state = np.empty((total, CHUNK, k)), into
    for t in range(CHUNK):
        state = np.where(valid[:, t, None], _unit(moved(state, t) * emit[:, t]), state)
        forward[:, t] = state
    state, expected = back, np.zeros((k, k))
    for t in range(CHUNK - 1, -1, -1):
        ahead = emit[:, t] * state
        if pairs:
            on = valid[:, t] & ~begins if t == 0 else valid[:, t]
            before = into if t == 0 else forward[:, t - 1]
            both = before[on][:, :, None] * step[None] * ahead[on][:, None, :]
            expected += (both / np.maximum(both.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)
        forward[:, t] *= state
        state = np.where(valid[:, t, None], _unit(ahead @ step.T), state)
    out = forward.reshape(-1, k)[at]
    out = out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)
    return (out, expected) if pairs else out


def sample(docs: DataFrame, train: Column, key: str, text: str, lang: str, per_label: int = SAMPLE) -> list[tuple[str, str]]:
    """About per_label whole texts of each language, by a hash of the key: a bounded number of bounded texts."""
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), hash60("crf", F.col(key)).alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages")
    if not counts:
        return []
    wanted = F.lit(False)
    for code in sorted(counts):
        wanted |= (F.col("lang") == code) & (F.col("h") < int(2**60 * min(1.0, per_label / counts[code])))
    chosen = rows.where(wanted).limit(3 * per_label * len(counts)).collect()
    return sorted((r["lang"], r["text"]) for r in chosen)


def fit(texts: list[tuple[str, str]], seed: int = 11, epochs: int = 3, batch_words: int = 8192) -> Crf:
    """Train on (language, text) pairs by AdaGrad on the conditional likelihood of code-switched sequences."""
    labels = sorted({lang for lang, _ in texts})
    k, rng = len(labels), np.random.default_rng(seed)
    model = Crf(labels, np.zeros((len(GRAMS), GRAM_BUCKETS, k), np.float32), np.zeros((WORD_BUCKETS, k), np.float32), np.zeros((k, k)))
    if k < 2:
        return model
    segments = []
    for lang, text in texts:
        words, at = re.findall(WORD, text), 0
        while at < len(words):
            n = int(rng.integers(4, 48))
            segments.append((labels.index(lang), words[at : at + n]))
            at += n
    sums = [np.full_like(model.grams, 1e-2), np.full_like(model.words, 1e-2), np.full_like(model.transitions, 1e-2)]
    for _ in range(epochs):
        batch, size = [], 0
        for i in [*rng.permutation(len(segments)), -1]:
            if i >= 0:
                batch.append(segments[i])
                size += len(segments[i][1])
            if batch and (size >= batch_words or i < 0):
                _step(model, batch, sums)
                batch, size = [], 0
    return model


def gradient(model: Crf, texts: list[str], truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gradient of -log P(truth | texts), for each word, by the weights of n-grams, words and transitions."""
    grams, word, starts, stops, first = features(texts)
    if len(truth) != len(word):
        raise ValueError("a label is needed for each word")
    scores, _ = emissions(model, texts)
    k, n = len(model.labels), len(truth)
    error, expected = posteriors(scores, first, model.transitions, pairs=True)
    error[np.arange(n), truth] -= 1
    inner = np.ones(n, bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    b = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (truth[b - 1], truth[b]), 1)
    out = (np.zeros_like(model.grams), np.zeros_like(model.words), (expected - seen) / n)
    for i, m in enumerate(GRAMS):
        low, high = _ranges(m, len(grams[i]), starts, stops)
        sizes = high - low
        where = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        own = np.repeat(np.arange(n), sizes)
        for j in range(k):
            out[0][i, :, j] = np.bincount(grams[i][where], error[own, j], GRAM_BUCKETS) / n
    for j in range(k):
        out[1][:, j] = np.bincount(word, error[:, j], WORD_BUCKETS) / n
    return out


def _step(model: Crf, batch: list[tuple[int, list[str]]], sums: list[np.ndarray], rate: float = 0.3, per_text: int = 6) -> None:
    """One AdaGrad step; each text is per_text segments strung together."""
    groups = [batch[i : i + per_text] for i in range(0, len(batch), per_text)]
    texts = [" ".join(w for _, ws in g for w in ws) for g in groups]
    truth = np.concatenate([np.full(len(ws), lang) for g in groups for lang, ws in g])
    for x, g, s in zip((model.grams, model.words, model.transitions), gradient(model, texts, truth), sums, strict=True):
        s += g * g * 1e4
        x -= rate * g * 1e2 / np.sqrt(s)


def _segments(text: str, most: int) -> list[str]:
    """A text in runs of about most code points, cut at spaces."""
    out, at = [], 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def long_posteriors(model: Crf, text: str, most: int) -> Iterator[np.ndarray]:
    """The posteriors of the words of one long text, segment by segment; only transfer matrices of segments are held."""
    parts = [p for p in _segments(text, most) if re.search(WORD, p)]
    if not parts:
        return
    k = len(model.labels)
    transfers = [transfer_of(emissions(model, [p])[0], model.transitions, i == 0) for i, p in enumerate(parts)]
    into, back = [np.ones(k)], [np.ones(k)]
    for m in transfers[:-1]:
        into.append(_unit((into[-1] @ m)[None])[0])
    for m in reversed(transfers[1:]):
        back.append(_unit((m @ back[-1])[None])[0])
    for i, (p, leaving) in enumerate(zip(parts, reversed(back), strict=True)):
        scores, first = emissions(model, [p])
        yield posteriors(scores, first, model.transitions, into[i] if i else None, leaving)


def _runs(best: np.ndarray, labels: list[str]) -> list[dict]:
    cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
    return [{"start": a, "stop": b, "lang": labels[best[a]]} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _predict(model: Crf, spans: bool, segment_bytes: int):
    most = max(1000, segment_bytes * 16 // max(16, len(model.labels) ** 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*model.labels, UNKNOWN], dtype=object)
        for batch in batches:
            for piece in pieces(batch, "text", most):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                n, k = len(texts), len(model.labels)
                pick, score, runs = np.full(n, k), np.zeros(n), [[] for _ in texts]
                if k:
                    if n == 1 and len(texts[0]) > most:
                        sums, size, bests = np.zeros(k), np.zeros(1, np.int64), []
                        for post in long_posteriors(model, texts[0], most):
                            sums, size = sums + post.sum(axis=0), size + len(post)
                            if spans:
                                bests.append(post.argmax(axis=1).astype(np.uint8))
                        best, first = np.concatenate(bests) if bests else np.zeros(0, np.uint8), [0, int(size[0])]
                        mean = sums[None] / np.maximum(size, 1)[:, None]
                    else:
                        scores, first = emissions(model, texts)
                        post = posteriors(scores, first, model.transitions)
                        size = np.diff(first)
                        own = np.repeat(np.arange(n), size)
                        mean = np.stack([np.bincount(own, post[:, j], n) for j in range(k)], axis=1) / np.maximum(size, 1)[:, None]
                        best = post.argmax(axis=1) if spans and len(post) else np.zeros(0, np.uint8)
                    known = np.array([LETTER.search(t) is not None for t in texts]) & (size > 0)
                    pick = np.where(known, mean.argmax(axis=1), k)
                    score = np.where(known, np.clip(mean.max(axis=1), 0.0, 1.0), 0.0)
                    if spans:
                        for i in np.flatnonzero(known):
                            runs[i] = _runs(best[first[i] : first[i + 1]], model.labels)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key"), piece.column("held_out"), pa.array(labels[pick], pa.string()), pa.array(score), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())])))],
                    names=["key", "held_out", "lang_pred", "score", "runs"],
                )

    return run


def labelled(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", spans: bool = True, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(key, held_out, lang_pred, score, runs) of each row of docs; train marks the rows to learn from.

    runs are the runs of words of one language (start and stop count words), empty unless spans. Null
    texts and texts without a letter are ``und`` with score 0; so is every text if there is nothing to
    learn from. Equal texts get equal results. An empty table gives an empty result. Keys are long
    integers.
    """
    model = fit(sample(docs, train, key, text, lang))
    rows = docs.select(F.col(key).cast("long").alias("key"), (~F.coalesce(train, F.lit(False))).alias("held_out"), F.col(text).alias("text"))
    out = rows.mapInArrow(_predict(model, spans, segment_bytes), "key long, held_out boolean, lang_pred string, score double, runs array<struct<start:int,stop:int,lang:string>>")
    return out.withColumnRenamed("key", key)
