"""Online linear learners (X3; M8-M11): SGD, perceptron, passive-aggressive.

Rows are dealt to a fixed number of shards by a hash of the key and ordered by
another inside each, so the updates are the same on any cluster.  An
epoch makes one pass: every shard starts from the common weights and updates
them row by row; the shards' weights are averaged by their rows (iterative
parameter mixing, Zinkevich et al. 2010; McDonald et al. 2010).  With one
shard it is the sequential learner.

A shard's rows stream through in blocks.  The margins of a block are one
matrix product, and its Gram matrix says how an update moves the margins of
the rows after it: so the updates of a block are found together, in a few
products of this small matrix, and are those of going row by row.  A task holds
the features of ``MADE`` rows.

Epochs stop by the reference library's rule: the mean loss of the rows, each
before its update, has not fallen by ``tol`` below the best for
``no_change`` epochs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanframe.functions.cells import PART
from loanframe.functions.gram import ArrowBatch, Interactions, tree_sums
from loanframe.operators.models import FEATURES, KEY, LABEL, LinearScorer, _width
from loanframe.session import shared_table

#: Rows of a block: its Gram matrix has the square of it.  Rows whose features are made at a time; rows of a packed row.
BLOCK, LOG_BLOCK, MADE, PACK = 64, 256, 512, 4096
#: Rounds over a block before its rows are gone through one by one.
ROUNDS = 12
LOWER = np.tril(np.ones((BLOCK, BLOCK)), -1)
#: Shards of a fit: a parameter of the result, not of the cluster.
SHARDS = 8

NAMES = {"log": "SGDClassifier(log_loss)", "hinge": "SGDClassifier(hinge)",
         "perceptron": "Perceptron", "pa": "PassiveAggressiveClassifier"}


class Learner:
    """One shard's weights.  The weights are ``scale * u``: SGD shrinks them at every row by a factor that depends
    on the row's number alone.

    But for the log loss, a learner adds ``d * size`` times a row to u, and ``d * push`` to the intercept, where d depends on the row's
    margin.  In a block the margins are ``m + effect @ d``: m by the weights before the block, ``effect`` (strictly
    lower triangular) from its Gram matrix.  So d is the one solution of ``d = response(m + effect @ d)``."""

    def __init__(self, kind: str, w: np.ndarray, b: float, t: int, alpha: float, C: float):
        self.kind, self.u, self.b, self.t, self.alpha, self.C = kind, w.copy(), float(b), t, alpha, C
        self.scale, self.n, self.loss, self.rows = 1.0, 0, 0.0, LOG_BLOCK if kind == "log" else BLOCK
        # the 'optimal' schedule: the rate of row t is 1 / (alpha (t0 + t - 1)), rows from 1
        self.t0 = 1.0 / (math.sqrt(1.0 / math.sqrt(alpha)) * alpha) if kind in ("log", "hinge") else 1.0

    def block(self, x: np.ndarray, y: np.ndarray) -> None:
        """Update by rows ``x`` with labels ``y`` (-1 or 1), in order; at most ``self.rows``."""
        if not len(y):
            return
        (self._log if self.kind == "log" else self._together)(x, y, x @ x.T)
        self.n += len(y)
        self.t += len(y)

    def _together(self, x, y, gram):
        norms = gram.diagonal().copy()
        if self.kind == "hinge":
            push, scale = self._rates(len(y))
            push *= y
            before, size = np.concatenate([[self.scale], scale[:-1]]), push / scale
        else:
            before, scale, push, size = np.ones(len(y)), np.ones(1), y, y
        m = y * (before * (x @ self.u) + self.b)
        effect = gram
        effect *= size
        effect *= before[:, None]
        effect += push
        effect *= y[:, None]
        effect *= LOWER[:len(y), :len(y)]
        if not np.isfinite(m).all():
            effect[:, ~np.isfinite(m)] = 0.0                     # such a row changes nothing where margins decide
        d, m = _in_turn(m, effect, *getattr(self, f"_{self.kind}")(norms), self.kind != "pa")
        gap = (0.0 if self.kind == "perceptron" else 1.0) - m
        self.loss += float(gap[gap > 0].sum())
        self.u += (d * size) @ x
        self.b += float(d @ push)
        self._rescale(float(scale[-1]))

    def _rates(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rates of the next n rows, and the scale each leaves: products of (1 - rate * alpha)."""
        rate = 1.0 / (self.alpha * (self.t0 + self.t - 1 + np.arange(n)))
        return rate, self.scale * np.cumprod(np.maximum(1.0 - rate * self.alpha, 0.0))

    def _log(self, x, y, gram):
        """Row by row, in one order of sums: while the rates are high, what the last bit of a margin is decides the weights."""
        rate, scale = self._rates(len(y))
        g, before = x @ self.u, self.scale                       # u . x of every row as it is now
        steps, moved = np.zeros(len(y)), np.empty(len(y))
        for i, (yi, eta, after) in enumerate(zip(y.tolist(), rate.tolist(), scale.tolist())):
            z = yi * (before * float(g[i]) + self.b)
            if z > 0:
                e = math.exp(-z)
                self.loss += math.log1p(e)
                d = yi * e / (1.0 + e)
            else:
                e = math.exp(z)
                self.loss += math.log1p(e) - z
                d = yi / (1.0 + e)
            before = after
            steps[i] = step = eta * d / before
            self.b += eta * d
            if step:
                rest = g[i + 1:]
                np.add(rest, np.multiply(gram[i, i + 1:], step, out=moved[i + 1:]), out=rest)
        self.u += steps @ x
        self._rescale(float(scale[-1]))

    # the d of all margins, and that of row i's margin

    def _hinge(self, _):
        return lambda m: (m < 1.0).astype(float), lambda _, m: float(m < 1.0)

    def _perceptron(self, _):
        """A row at or beyond the wrong side is added."""
        return lambda m: (m <= 0.0).astype(float), lambda _, m: float(m <= 0.0)

    def _pa(self, norms):
        """A row within the margin is added as far as it needs, ``C`` at most."""
        most = norms.tolist()

        def one(i, m):
            return min(self.C, (1.0 - m) / most[i]) if m < 1.0 and most[i] > 0 else 0.0
        return None, one

    def _rescale(self, scale: float) -> None:
        self.scale = scale
        if scale < 1e-9:
            self.u *= scale
            self.scale = 1.0

    def weights(self) -> np.ndarray:
        return self.scale * self.u


def _in_turn(m: np.ndarray, effect: np.ndarray, every, one, together: bool) -> tuple[np.ndarray, np.ndarray]:
    """(d, margins) with ``margins = m + effect @ d`` and d its response, as rows one after another give them.

    A round answers all rows at once; rows before the first whose answer changed have their last one, and mostly
    all have after a few rounds.  What ``ROUNDS`` don't settle, or all without ``together``, is gone through row by row."""
    n, at = len(m), 0
    if together:
        d = every(m)
        for _ in range(ROUNDS):
            z = m + effect @ d
            new = every(z)
            changed = np.flatnonzero(new != d)
            if not len(changed):
                return d, z
            d, at = new, int(changed[0])
    else:
        d = np.zeros(n)
    z = m.copy()
    if at:
        z[:at] += effect[:at, :at] @ d[:at]
    for i in range(at, n):
        z[i] = v = float(m[i] + effect[i, :i].dot(d[:i]))
        d[i] = one(i, v)
    return d, z


def _sharded(train: DataFrame, features: str, label: str, key: str, shards: int, seed: int) -> DataFrame:
    """(shard, place, y, features) with the shards' rows together and in order, written once."""
    d = train.where(F.col(label).isNotNull()).select(
        F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(shards)).cast("int").alias("shard"),
        F.xxhash64(F.lit(seed + 1), F.col(key)).alias("place"),
        (F.col(label).cast("double") * 2.0 - 1.0).alias("y"), F.col(key).alias("key"), F.col(features).alias("x"))
    return shared_table(d, "online-rows")


class Dealt:
    """The rows of ``train`` as the learners read them, epoch after epoch; several fits may share them."""

    def __init__(self, train: DataFrame, features: str = FEATURES, label: str = LABEL, key: str = KEY,
                 shards: int = SHARDS, seed: int = 42):
        rows = _sharded(train, features, label, key, shards, seed)
        self.flags = _flags(rows)
        self.order = _in_order(rows, self.flags, shards).persist()

    def close(self) -> None:
        self.order.unpersist()


def fit_online(train: DataFrame, kind: str = "log", max_iter: int = 1000, alpha: float = 1e-4,
               C: float = 1.0, tol: float = 1e-3, no_change: int = 5, features: str = FEATURES, label: str = LABEL,
               key: str = KEY, shards: int = SHARDS, seed: int = 42, expand: Interactions | None = None,
               dealt: Dealt | None = None) -> LinearScorer:
    """kind: ``log`` (SGD logistic, M8), ``hinge`` (SGD SVM, M9), ``perceptron`` (M10), ``pa`` (passive-aggressive I,
    M11).  ``info``: epochs, whether the tolerance stopped them, mean loss of each epoch.

    Rows without a label are left out; equal keys are ordered by their rows.  Without rows the weights are zero.
    With ``expand`` the array column holds what the features are made of, block by block.  ``dealt``: the rows, if they
    have been dealt to shards.
    """
    if kind in ("log", "hinge") and not 0 < alpha < 1:
        raise ValueError("the 'optimal' schedule needs an alpha between 0 and 1")
    p = expand.width() if expand else _width(train, features)
    mine = dealt or Dealt(train, features, label, key, shards, seed)
    flags, order = mine.flags, mine.order
    try:
        w, b, seen = np.zeros(p), 0.0, 0.0
        best, waited, losses = math.inf, 0, []
        while len(losses) < max_iter and waited < no_change:
            def epoch(batches: Iterator[pa.RecordBatch], w=w, b=b, t=1 + int(seen)) -> Iterator[pa.RecordBatch]:
                yield from _epoch(_unpacked(batches, flags), lambda: Learner(kind, w, b, t, alpha, C), expand)

            got = order.mapInArrow(epoch, "n long, loss double, v array<double>").collect()       # one row a shard
            n = sum(r["n"] for r in got)
            if not n:
                break
            got.sort(key=lambda r: (r["n"], r["loss"], r["v"]))                                   # sums in one order
            v = sum(np.array(r["v"]) * r["n"] for r in got) / n
            w, b, seen = v[:p], float(v[p]), seen + n / len(got)
            losses.append(sum(r["loss"] for r in got) / n)
            waited = waited + 1 if losses[-1] > best - tol else 0
            best = min(best, losses[-1])
        return LinearScorer(NAMES[kind], w, b, link="logit" if kind == "log" else "none",
                            info={"rounds": len(losses), "converged": waited >= no_change, "losses": losses})
    finally:
        if dealt is None:
            mine.close()


def _in_order(rows: DataFrame, flags: np.ndarray, shards: int) -> DataFrame:
    """Every shard's rows together and in order, as rows of up to ``PACK`` rows with 0/1 columns as bits.  They are sorted
    and packed in ranges of ``PART`` rows: the task that has a shard reads its blocks alone, few bytes a row."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for at, b in enumerate(_packed(batches, flags)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int32()), *b.columns],
                                             names=["part", "at", *b.schema.names])

    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART))
    ranged = rows.repartitionByRange(parts, "shard", "place", "key").sortWithinPartitions("shard", "place", "key", "y", "x")
    packed = shared_table(ranged.select("shard", "y", "x").mapInArrow(pack, f"part int, at int, {PACKED}"), "online-blocks")
    # a partition a shard: by a hash two shards may share one while another is empty
    return packed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "part", "at").drop("part", "at")


PACKED = "shard int, n int, y binary, bits binary, numbers binary"


def _flags(rows: DataFrame) -> np.ndarray:
    """Which columns of ``x`` are 0 or 1 (and not -0.0) in every row."""
    def other(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        acc = None
        for batch in batches:
            if batch.num_rows:
                x = ArrowBatch(batch).matrix("x")
                v = ((x != 1) & ((x != 0) | np.signbit(x))).sum(axis=0).astype(float)
                acc = v if acc is None else acc + v
        return {} if acc is None else {"": acc}

    got = tree_sums(rows.select("x"), other).get("")
    return np.zeros(0, dtype=bool) if got is None else got == 0


def _packed(batches: Iterator[pa.RecordBatch], flags: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (shard, y, x) as rows of up to ``PACK`` rows of one shard."""
    for batch in batches:
        if not batch.num_rows:
            continue
        of, b = batch.column(0).to_numpy(), ArrowBatch(batch)
        x, y = b.matrix("x"), b["y"].to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for a, z in zip(cuts, cuts[1:]):
            for lo in range(a, z, PACK):
                hi = min(lo + PACK, z)
                yield pa.RecordBatch.from_arrays([pa.array([of[lo]], pa.int32()), pa.array([hi - lo], pa.int32()), *[
                    pa.array([v.tobytes()], pa.binary()) for v in (
                        y[lo:hi], np.packbits(x[lo:hi, flags] == 1, axis=1), np.ascontiguousarray(x[lo:hi, ~flags]))]],
                    names=[c.split()[0] for c in PACKED.split(", ")])


def _unpacked(batches: Iterator[pa.RecordBatch], flags: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, x, y) of every packed row, as they were."""
    k = int(flags.sum())
    for batch in batches:
        for shard, n, y, bits, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.empty((n, len(flags)))
            x[:, flags] = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(n, -1), axis=1, count=k) if k else 0.0
            x[:, ~flags] = np.frombuffer(numbers).reshape(n, -1)
            yield shard, x, np.frombuffer(y)


def _epoch(parts: Iterator[tuple[int, np.ndarray, np.ndarray]], fresh, expand: Interactions | None = None) -> Iterator[pa.RecordBatch]:
    """Run a learner over every shard of sorted rows, in blocks of as many rows whatever the batches."""
    shard, learner = None, None
    x_held, y_held = [], []

    def flush(everything: bool):
        nonlocal x_held, y_held
        size = sum(map(len, y_held))
        if not size or not everything and size < MADE:
            return
        x, y = np.concatenate(x_held), np.concatenate(y_held)
        end = size if everything else size - size % MADE
        for lo in range(0, end, MADE):
            hi = min(lo + MADE, end)
            made = expand.columns(x[lo:hi].T) if expand else x[lo:hi].T
            for at in range(0, hi - lo, learner.rows):
                end_ = min(at + learner.rows, hi - lo)
                learner.block(np.ascontiguousarray(made[:, at:end_].T), y[lo + at:lo + end_])
        x_held, y_held = [x[end:]], [y[end:]]

    def out():
        flush(True)
        v = np.concatenate([learner.weights(), [learner.b]])
        return pa.RecordBatch.from_pydict({"n": [learner.n], "loss": [learner.loss], "v": [v.tolist()]})

    for of, x, y in parts:
        if of != shard:
            if learner is not None:
                yield out()
            shard, learner, x_held, y_held = of, fresh(), [], []
        x_held.append(x)
        y_held.append(y)
        flush(False)
    if learner is not None:
        yield out()
