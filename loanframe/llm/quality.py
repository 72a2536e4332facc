"""Text quality from random-indexing word vectors and a small network (operator 2).

1. Every hashed word, and every hashed word shape (``a`` for a run of small
   letters, ``A`` for capitals, ``0`` for digits, other ASCII signs as they are), has a
   fixed sparse ternary index vector.  One pass over all documents adds the
   index vectors of the neighbours of every word to its row and to its
   shape's row: random indexing.  Rows are centred and scaled to length one.
2. A text's word vectors (word row plus shape row) are pooled: mean, spread,
   and mean change from word to word, with the log of the number of words.
3. A two-layer network (numpy, Adam) learns the label from pooled vectors of a
   bounded sample of labelled rows; a share of those it hasn't seen sets the
   temperature that calibrates its probabilities.

The word vectors are one bounded array (12,288 rows of 32 numbers) whatever
the corpus; texts are read where they lie and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanframe.llm.common import _BYTE, _POWER, GOLD, SPACE, map_batches, mix64, passing, texts_of
from loanframe.llm.labels import remainder, sample

WORDS, SHAPES, DIM, ONES = 8192, 4096, 32, 4
ROWS = WORDS + SHAPES
POOLED = 3 * DIM + 1
#: Labelled rows the network is fitted on at most (their pooled vectors are 400 bytes each on the driver).
FIT_ROWS = 20_000
#: Words whose vectors are in memory at once while a text is pooled.
CHUNK = 1 << 16

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x61:0x7B] = _CLASS[0x80:] = 0x61
_CLASS[0x41:0x5B] = 0x41
_CLASS[0x30:0x3A] = 0x30


def _index_vectors() -> np.ndarray:
    """Sparse ternary vectors: ``ONES`` signed ones a row, at places fixed by hashing the row's number."""
    out = np.zeros((ROWS, DIM), dtype=np.float32)
    for i in range(ONES):
        z = mix64(np.arange(1, ROWS + 1, dtype=np.uint64) * GOLD + np.uint64(i))
        np.add.at(out, (np.arange(ROWS), (z % np.uint64(DIM)).astype(np.int64)), np.where(z >> np.uint64(63), 1, -1))
    return out


def _sums(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    first = np.cumsum(size) - size
    at = np.arange(len(raw)) - np.repeat(first, size)
    return mix64(np.add.reduceat(_BYTE[raw] * _POWER[at & 0xFFFF], first) + size.astype(np.uint64) * GOLD)


def word_rows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Row of the word and row of its shape, for every word between ASCII white space."""
    raw = np.frombuffer(text, dtype=np.uint8)
    inside = ~SPACE[raw]
    step = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = ends - starts
    letters = raw[inside]
    shape = _CLASS[letters]
    new = np.ones(len(shape), dtype=bool)
    new[1:] = shape[1:] != shape[:-1]
    first = np.cumsum(size) - size
    new[first] = True
    runs = np.add.reduceat(new.astype(np.int64), first)
    return ((_sums(letters, size) % np.uint64(WORDS)).astype(np.int64),
            (_sums(shape[new], runs) % np.uint64(SHAPES)).astype(np.int64) + WORDS)


def context_sums(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, vector): for every used row the sum of its neighbours' index vectors over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.ascontiguousarray(_index_vectors().T)
        acc = np.zeros((DIM, ROWS))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add():
            # a gap between texts keeps the last word of one from being the next one's neighbour
            gap = np.array([ROWS])
            words = np.concatenate([x for w, _ in held for x in (w, gap)])
            shapes = np.concatenate([x for _, s in held for x in (s, gap)])
            held.clear()
            for d in range(DIM):
                vec = np.append(index[d], np.float32(0))
                own = vec[words] + vec[shapes]
                near = np.zeros(len(own), dtype=np.float64)
                near[1:] += own[:-1]
                near[:-1] += own[1:]
                acc[d] += np.bincount(words, near, ROWS + 1)[:ROWS]
                acc[d] += np.bincount(shapes, near, ROWS + 1)[:ROWS]

        n = 0
        for b in batches:
            for text in texts_of(b.column(0)):
                w, s = word_rows(text)
                if len(w) > 1:
                    held.append((w, s))
                    n += len(w)
                    if n > 1 << 18:
                        add()
                        n = 0
        if held:
            add()
        used = np.flatnonzero(np.abs(acc).sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, DIM).astype(np.int32)), pa.array(np.tile(np.arange(DIM, dtype=np.int32), len(used))),
             pa.array(acc[:, used].T.reshape(-1).astype(np.int64))], names=["row", "dim", "value"])

    return (docs.select(text_col).mapInArrow(run, "row int, dim int, value long")
            .groupBy("row", "dim").agg(F.sum("value").alias("value")))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Word vectors of the whole corpus: ROWS x DIM, centred, of length one (zero for unused rows)."""
    out = np.zeros((ROWS, DIM), dtype=np.float32)
    got = context_sums(docs, text_col).toPandas()                 # at most ROWS x DIM numbers
    out[got["row"].to_numpy(), got["dim"].to_numpy()] = got["value"].to_numpy()
    for part in (out[:WORDS], out[WORDS:]):
        length = np.linalg.norm(part, axis=1, keepdims=True)
        np.divide(part, length, out=part, where=length > 0)
        used = length[:, 0] > 0
        if used.any():
            part[used] -= part[used].mean(axis=0)
        length = np.linalg.norm(part, axis=1, keepdims=True)
        np.divide(part, length, out=part, where=length > 1e-6)
    return out


def pool(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and mean change of a text's word vectors, and the log of its length; zeros without words."""
    words, shapes = word_rows(text)
    out = np.zeros(POOLED, dtype=np.float32)
    n = len(words)
    if not n:
        return out
    total, square, change = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
    last = None
    for i in range(0, n, CHUNK):
        v = vectors[words[i:i + CHUNK]] + vectors[shapes[i:i + CHUNK]]
        total += v.sum(axis=0)
        square += np.einsum("ij,ij->j", v, v)
        w = v if last is None else np.concatenate([last, v])
        change += np.abs(np.diff(w, axis=0)).sum(axis=0)
        last = v[-1:]
    mean = total / n
    out[:DIM] = mean
    out[DIM:2 * DIM] = np.sqrt(np.maximum(square / n - mean * mean, 0))
    out[2 * DIM:3 * DIM] = change / max(n - 1, 1)
    out[-1] = np.log1p(n)
    return out


@dataclass(frozen=True)
class Network:
    """Standardisation, two layers and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.01,
          decay: float = 1e-4, seed: int = 7) -> Network:
    """Two-layer network for labels 0/1; the last fifth of the rows (in hashed order) sets the temperature.

    With no rows the answer is one half, with one class its smoothed share.
    """
    n, d = x.shape
    share = (y.sum() + 1) / (n + 2)
    flat = Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    if n < 20 or y.min() == y.max():
        return flat
    rnd = np.random.default_rng(seed)
    order = rnd.permutation(n)
    fit, cal = order[n // 5:], order[:n // 5]
    mean, scale = x[fit].mean(axis=0), np.maximum(x[fit].std(axis=0), 1e-4)
    z = (x - mean) / scale
    p = [rnd.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rnd.normal(0, 1 / np.sqrt(hidden), hidden),
         np.array(flat.b2)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    t = 0
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for i in range(0, len(fit), 256):
            at = fit[i:i + 256]
            h = np.tanh(z[at] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - y[at]) / len(at)
            back = np.outer(err, p[2]) * (1 - h * h)
            grads = [z[at].T @ back + decay * p[0], back.sum(axis=0), h.T @ err + decay * p[2], np.array(err.sum())]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - lr * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
        rnd.shuffle(fit)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3]))
    raw, target = net.logits(x[cal]), y[cal]

    def loss(temp):
        q = np.clip(1 / (1 + np.exp(-np.clip(raw / temp, -60, 60))), 1e-12, 1 - 1e-12)
        return -(target * np.log(q) + (1 - target) * np.log(1 - q)).mean()

    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
    best = min(grid, key=loss)
    return Network(mean, scale, p[0], p[1], p[2], float(p[3]), float(best))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors of all ``docs(doc_id, text)`` and the network learnt from ``labels(doc_id, label)``."""
    vectors = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [pool(t, sent.value) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float32()))],
                                             names=["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")    # at most FIT_ROWS times 12 bytes
    got = marked.mapInArrow(run, f"doc_id {kind}, label int, x array<float>").toPandas()
    got = got.drop_duplicates("doc_id").sort_values("doc_id")
    x = np.stack(got["x"].to_list()).astype(np.float64) if len(got) else np.zeros((0, POOLED))
    return vectors, train(x, got["label"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, vectors: np.ndarray, network: Network, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """(id, score) of every row; the text and other columns only where named in ``keep``.

    NULL and empty texts get the score of the zero vector; repeated rows score
    alike; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vectors, network))
    src, out, back = passing(docs, id_col, text_col, keep, [("score", "double")])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        vec, net = sent.value
        # one text at a time: the sums of a batch would depend on its other texts in the last digit
        p = np.array([net.probabilities(pool(t, vec)[None])[0] for t in texts_of(b.column(1))])
        return back(b, [pa.array(p, pa.float64())])

    return map_batches(src, run, out)


MOD, HELD_OUT, THRESHOLD = 3, 1, 0.5


def trained(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    return fit(docs, sample(labels, "quality", MOD, HELD_OUT, FIT_ROWS))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = score(docs, *trained(docs, labels))
    return s.select("doc_id", (remainder(F.col("doc_id"), MOD) == HELD_OUT).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
