"""Toxic passages by maximum-scoring segments (operator 10).

1. Words are described by hashed features (the word and its beginnings of 4,
   5, 6 and 8 bytes).  One pass over all documents counts in how many of them
   each feature occurs: all documents, labelled toxic, labelled clean.
2. A feature's score is the lower bound of its log-odds of toxic against
   clean, with a Dirichlet prior in proportion to its count in the whole corpus.
   Two independent hash tables are kept and the lesser score holds, so one
   collision makes no word toxic.  A word has its best feature's score, at
   most zero where it repeats the word before it, and minus one without any.
3. A linear-time scan finds all maximal scoring segments of a text.  Scores of
   clean words give the Karlin-Altschul parameters; a segment of score S in n
   words is expected K n exp(-lambda S) times by chance.  The best segment's
   extreme-value score lambda S - ln(K n) is turned into a probability by
   logistic calibration on labelled rows whose words were not counted.

The model is two arrays of 2^18 scores whatever the corpus; counting shuffles
at most 2^19 rows a task.  Texts are read where they lie and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanframe.llm.common import _BYTE, _POWER, GOLD, mix64, passing, texts_of
from loanframe.llm.labels import remainder, sample

BITS = 18
PREFIXES = (4, 5, 6, 8)
#: Bytes between words: all of ASCII but letters and digits (texts come lower-cased).
BETWEEN = np.ones(256, dtype=bool)
BETWEEN[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = False
#: Prior documents a feature gets in proportion to its share of the corpus, plus half a one.
PRIOR = 20.0
#: Standard deviations below the log-odds that count as its lower bound.
Z = 2.0
#: Log-odds that topic and language alone may make; only what exceeds them scores.
MARGIN = 1.0
MISS = -1.0
#: Bins of the calibration table: segment scores by quarters up to 100, texts by doublings of their words.
STEP, TOP = 0.25, 400


def features(text: bytes) -> np.ndarray:
    """Hashes of shape (features, words): the word and its beginnings (0 where a word is no longer)."""
    raw = np.frombuffer(text.lower(), dtype=np.uint8)
    inside = ~BETWEEN[raw]
    step = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.empty((1 + len(PREFIXES), 0), dtype=np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw[inside]] * _POWER[at & 0xFFFF])])
    out = np.zeros((1 + len(PREFIXES), len(size)), dtype=np.uint64)
    out[0] = mix64((total[first + size] - total[first]) + size.astype(np.uint64) * GOLD)
    for i, p in enumerate(PREFIXES, 1):
        longer = size > p
        f = first[longer]
        out[i, longer] = mix64((total[f + p] - total[f]) ^ np.uint64(p << 56))
    return out


def _buckets(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes in the two tables (the second behind the first)."""
    mask = np.uint64((1 << BITS) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64) + (1 << BITS)


def feature_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> DataFrame:
    """(bucket, n_all, n_toxic, n_clean): documents with a feature of that bucket; bucket -1 holds the totals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, 2 << BITS), dtype=np.int64)
        totals = np.zeros(3, dtype=np.int64)
        for b in batches:
            for text, label in zip(texts_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                h = np.unique(features(text))
                at = np.unique(np.concatenate(_buckets(h[h != 0])))
                rows = [0] if label is None else [0, 1 if label else 2]
                for r in rows:
                    counts[r, at] += 1
                    totals[r] += 1
        used = np.flatnonzero(counts[0])
        cols = [np.append(used, -1), *(np.append(counts[r, used], totals[r]) for r in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols],
                                         names=["bucket", "n_all", "n_toxic", "n_clean"])

    parts = docs.select(text_col, label_col).mapInArrow(run, "bucket long, n_all long, n_toxic long, n_clean long")
    return parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n_all", "n_toxic", "n_clean")])


def feature_scores(rows: pd.DataFrame) -> np.ndarray:
    """Score of every bucket: lower bound of the log-odds, at least ``MISS`` (2^19 numbers)."""
    scores = np.full(2 << BITS, MISS, dtype=np.float32)
    total = rows[rows.bucket == -1]
    if not len(total) or not total.n_toxic.iloc[0] or not total.n_clean.iloc[0]:
        return scores
    n, n1, n0 = (float(total[c].iloc[0]) for c in ("n_all", "n_toxic", "n_clean"))
    rows = rows[(rows.bucket >= 0) & (rows.n_toxic > 0)]
    prior = 0.5 + PRIOR * rows.n_all / n
    y1, y0 = rows.n_toxic + prior, rows.n_clean + prior
    room = PRIOR + 1.0
    odds = np.log(y1 / (n1 + room - y1).clip(lower=0.5)) - np.log(y0 / (n0 + room - y0).clip(lower=0.5))
    low = odds - Z * np.sqrt(1 / y1 + 1 / y0)
    scores[rows.bucket.to_numpy()] = np.where(low > MARGIN, low - MARGIN, MISS)
    return scores


def word_scores(text: bytes, scores: np.ndarray) -> np.ndarray:
    h = features(text)
    a, b = _buckets(h)
    s = np.minimum(scores[a], scores[b])
    s[h == 0] = MISS
    if not h.shape[1]:
        return np.empty(0, dtype=np.float32)
    best = s.max(axis=0)
    again = np.flatnonzero(h[0, 1:] == h[0, :-1]) + 1
    best[again] = np.minimum(best[again], 0)            # one word over and over is one piece of evidence
    return best


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last word, score) in linear time, in order of place.

    Candidates are kept with the running sums before and after them, and with the place
    of the nearest one that began lower.  A new
    positive run joins the nearest candidate that began lower, unless nothing
    between has been higher than the new run's end; joining may repeat.
    Candidates that a search passes over stand before its link and are never
    looked at again, so all searches together are linear.
    """
    cum = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    out: list[tuple[int, int, float, float]] = []
    lower: list[int] = []
    for i in np.flatnonzero(scores > 0).tolist():
        cand = (i, i, float(cum[i]), float(cum[i + 1]))
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= cand[2]:
                j = lower[j]
            if j < 0 or out[j][3] >= cand[3]:
                out.append(cand)
                lower.append(j)
                break
            cand = (out[j][0], cand[1], out[j][2], cand[3])
            del out[j:], lower[j:]
    return [(a, b, r - lo) for a, b, lo, r in out]


@dataclass(frozen=True)
class Model:
    scores: np.ndarray
    lam: float
    k: float
    slope: float
    bias: float

    def extreme(self, score: float, words: int) -> float:
        """Extreme-value score: minus the log of how often chance gives such a segment."""
        return self.lam * score - np.log(self.k * max(words, 1))

    def probability(self, score: float, words: int) -> float:
        z = self.slope * self.extreme(score, words) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _table(docs: DataFrame, sent) -> DataFrame:
    """(kind, a, b, n): clean words by score step ('w'), texts by best segment, size and label ('s')."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = sent.value
        words = np.zeros(TOP + 8, dtype=np.int64)
        best = np.zeros((2, TOP + 1, 40), dtype=np.int64)
        for b in batches:
            for text, label in zip(texts_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                s = word_scores(text, scores)
                top = max((x[2] for x in segments(s)), default=0.0)
                best[label, min(int(top / STEP), TOP), int(np.log2(len(s) + 1))] += 1
                if not label:
                    words += np.bincount(np.clip(np.round(s / STEP), -4, TOP).astype(np.int64) + 4, minlength=len(words))
        w = np.flatnonzero(words)
        lab, top, size = np.nonzero(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["w"] * len(w) + ["s"] * len(lab)), pa.array(np.concatenate([w - 4, lab * 1000 + top]).astype(np.int64)),
             pa.array(np.concatenate([np.zeros(len(w)), size]).astype(np.int64)),
             pa.array(np.concatenate([words[w], best[lab, top, size]]).astype(np.int64))], names=["kind", "a", "b", "n"])

    parts = docs.select("text", "label").mapInArrow(run, "kind string, a long, b long, n long")
    return parts.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def karlin(values: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """lambda with sum p exp(lambda s) = 1, and K = p(positive) (an upper bound of the true factor)."""
    p = weights / weights.sum()
    if not (values > 0).any() or (p * values).sum() >= 0:
        return 1.0, 1e-4                                # no clean word scores: any positive word is beyond chance
    lo, hi = 1e-6, 50.0
    for _ in range(200):
        mid = (lo + hi) / 2
        with np.errstate(over="ignore"):
            lo, hi = (mid, hi) if (p * np.exp(mid * values)).sum() < 1 else (lo, mid)
    return lo, float(max(p[values > 0].sum(), 1e-9))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one standardised variable, lightly penalised, by Newton steps."""
    mean = (w * x).sum() / w.sum()
    sd = max(np.sqrt((w * (x - mean) ** 2).sum() / w.sum()), 1e-9)
    a = np.stack([(x - mean) / sd, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        grad = a.T @ (w * (y - p)) - np.array([0.05, 0.0]) * beta
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag([0.05, 1e-9]), grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta[0] / sd, beta[1] - beta[0] * mean / sd


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from ``docs(doc_id, text)`` and labelled rows ``labels(doc_id, label)``.

    A quarter of the labelled rows calibrates and is not counted.  Without
    toxic or without clean rows no word scores and every text gets the rate of the labels
    (0 without any).
    """
    spark = docs.sparkSession
    fold = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0
    rows = docs.select("doc_id", "text")
    # one row for each labelled id of the bounded sample: at most MAX_LABELS times 12 bytes
    marked = rows.join(F.broadcast(labels.withColumn("label", F.when(~fold, F.col("label")))), "doc_id", "left")
    scores = feature_scores(feature_counts(marked).toPandas())
    sent = spark.sparkContext.broadcast(scores)
    seen = _table(rows.join(F.broadcast(labels.where(fold)), "doc_id"), sent).toPandas()
    w, s = seen[seen.kind == "w"], seen[seen.kind == "s"]
    lam, k = karlin(w.a.to_numpy() * STEP, w.n.to_numpy(float)) if len(w) else (1.0, 1e-4)
    model = Model(scores, lam, k, 0.0, -30.0)
    if len(s):
        y, top = (s.a // 1000).to_numpy(float), (s.a % 1000).to_numpy() * STEP
        x = np.array([model.extreme(t, 2.0 ** b * 1.5) for t, b in zip(top, s.b, strict=True)])
        n = s.n.to_numpy(float)
        if 0 < (n * y).sum() < n.sum():
            slope, bias = _logistic(x, y, n)
        else:
            slope, bias = 0.0, 30.0 if y.any() else -30.0
        model = Model(scores, lam, k, slope, bias)
    return model


PASSAGE = "array<struct<first:long,last:long,score:double,expected:double>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str] | None = None, significance: float = 0.01) -> DataFrame:
    """(id, score, passages) of every row; the text and other columns only where named in ``keep``.

    ``passages``: word positions, score and chance expectation of every
    maximal segment expected less than ``significance`` times by chance.  NULL
    and empty texts have no words, no passages, and the score of the least
    toxic text; repeated rows score alike; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    src, out, back = passing(docs, id_col, text_col, keep, [("score", "double"), ("passages", PASSAGE)])
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()),
                               ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            p, found = [], []
            for text in texts_of(b.column(1)):
                s = word_scores(text, m.scores)
                segs = segments(s)
                p.append(m.probability(max((x[2] for x in segs), default=0.0), len(s)))
                rare = [(x, float(np.exp(-m.extreme(x[2], len(s))))) for x in segs]
                found.append([{"first": x[0], "last": x[1], "score": x[2], "expected": e} for x, e in rare if e < significance])
            yield back(b, [pa.array(p, pa.float64()), pa.array(found, kind)])

    return src.mapInArrow(run, out)


MOD, HELD_OUT, THRESHOLD = 4, 2, 0.3


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, sample(labels, "toxic", MOD, HELD_OUT))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = score(docs, trained(docs, labels))
    return s.select("doc_id", (remainder(F.col("doc_id"), MOD) == HELD_OUT).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
