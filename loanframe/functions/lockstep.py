"""Many penalised linear classifiers fitted together (X4 for grids).

All models of a search (outer folds x inner folds x candidates) take their
proximal Newton steps in lockstep: one pass over the rows gives every model
that hasn't converged its loss, gradient and Hessian over its own training
rows, summed cell by cell (``functions/cells.py``).  A pass makes a vector a
model and partition; the task that adds a model's vectors solves its next step
too, so the driver gets losses, gradients and steps, no Hessians.

A model trains on the rows with ``outer`` not its ``outer`` (None: all rows)
and, in an inner cross-validation, with ``folds`` not its ``fold``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanframe.functions.cells import CellRows, Sums, blocks, cell_rows, coefficients, stored, summed, unpacked
from loanframe.functions.gram import Interactions, tree_sums

#: Scores that a task holds before it packs them, rows of a part of a model's scores, and rows of the sample for each part.
HELD, RUN, SAMPLE = 1 << 22, 1 << 21, 1 << 12


@dataclass
class Fit:
    """One model: its training rows, penalty and class weights; ``beta`` ends with the intercept."""

    outer: int | None = None
    folds: str | None = None
    fold: int | None = None
    C: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    weights: tuple[float, float] = (1.0, 1.0)          # of class 0, of class 1
    loss: str = "logistic"
    penalize_intercept: bool = False
    keep: np.ndarray | None = None                     # features it may use (None: all)
    beta: np.ndarray | None = None
    converged: bool = False
    steps: int = 0
    state: dict = field(default_factory=dict)

    def trains(self, outer: np.ndarray, folds: dict[str, np.ndarray]) -> np.ndarray:
        rows = np.ones(len(outer), dtype=bool) if self.outer is None else outer != self.outer
        return rows & (folds[self.folds] != self.fold) if self.folds else rows

    def holds_out(self, outer: np.ndarray, folds: dict[str, np.ndarray]) -> np.ndarray:
        """Rows that judge the model: its inner fold in its training part, or its outer fold."""
        if self.folds:
            rows = np.ones(len(outer), dtype=bool) if self.outer is None else outer != self.outer
            return rows & (folds[self.folds] == self.fold)
        return outer == self.outer


def _rows(d: DataFrame | CellRows, fits: list[Fit], expand: Interactions | None = None) -> CellRows:
    """``d`` stored as cells, unless it is."""
    if isinstance(d, CellRows):
        return d
    return stored(cell_rows(d, "features", ["label", "outer", *sorted({f.folds for f in fits if f.folds})], expand))


def losses(loss: str, s: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature by the score ``s`` of rows (a column a model) with label y (0 or 1) and weight w."""
    if loss == "logistic":
        e = np.exp(-np.abs(s))
        p = np.where(s >= 0, 1.0, e) / (1.0 + e)
        return w * (np.maximum(s, 0.0) + np.log1p(e) - y * s), w * (p - y), w * p * (1.0 - p)
    sign = 2.0 * y - 1.0
    gap = 1.0 - sign * s
    act = np.where(gap > 0, w, 0.0)
    gap = np.where(gap > 0, gap, 0.0)
    return act * gap * gap, -2.0 * act * np.where(act > 0, sign, 0.0) * gap, 2.0 * act


def _pass(d: CellRows, change: np.ndarray, fits: list[Fit], betas: list[np.ndarray], uses: list[np.ndarray] | None,
          free: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Loss and gradient (unpenalised, times 1) of every model at its beta, and the step from there over the
    coordinates ``uses`` (None: those that ``_used`` names).  The task that has a model's sums solves its step."""
    cells, q = d.cells, len(betas[0])
    cols = sorted({f.folds for f in fits if f.folds})
    jobs = [Fit(f.outer, f.folds, f.fold, f.C, f.l1, f.l2, f.weights, f.loss) for f in fits]
    gamma = change.T @ np.stack(betas, axis=1)
    of_loss = {kind: np.array([m for m, f in enumerate(jobs) if f.loss == kind]) for kind in sorted({f.loss for f in jobs})}
    w0, w1 = (np.array([f.weights[c] for f in jobs]) for c in (0, 1))

    def work(batches):
        sums, total = Sums(cells, len(jobs), True), np.zeros((len(jobs), 1))
        for bits, n, b in blocks(batches, ["label", "outer", *cols]):
            y = b.column(2).to_numpy(zero_copy_only=False).astype(float)[:, None]
            trains = _masks(jobs, b, cols, Fit.trains)
            terms = cells.terms(n)
            s = terms @ coefficients(cells, bits, gamma)
            w = np.where(y > 0.5, w1, w0)
            value, slope, curve = np.empty_like(s), np.empty_like(s), np.empty_like(s)
            for kind, m in of_loss.items():
                if len(m) == len(jobs):
                    value, slope, curve = losses(kind, s, y, w)
                else:
                    value[:, m], slope[:, m], curve[:, m] = losses(kind, s[:, m], y, w[:, m])
            out = ~trains
            for v in (value, slope, curve):
                v[out] = 0.0
            total[:, 0] += value.sum(axis=0)
            sums.add(bits, terms, slope, curve)
        return sums.vectors(total)

    def finish(name, v):
        m = int(name)
        f = jobs[m]
        g, h = unpacked(cells, change, v[1:1 + q], v[1 + q:])
        use = uses[m] if uses is not None else _used(f, betas[m], g, l1[m], l2[m], free[m])
        hu, gu, b = f.C * h[np.ix_(use, use)], f.C * g[use], betas[m][use]
        way = np.zeros(q)
        if f.l1 > 0:
            way[use] = _l1_step(hu, gu, b, l1[m][use], l2[m][use])
        else:
            way[use] = -np.linalg.solve(hu + np.diag(l2[m][use]) + 1e-12 * np.eye(len(use)), gu + l2[m][use] * b)
        return np.concatenate([v[:1], g, way])

    got = summed(d, ["label", "outer", *cols], len(jobs), work, finish)
    zero = np.zeros(q)
    return [(float(v[0]), v[1:1 + q], v[1 + q:]) if (v := got.get(str(m))) is not None else (0.0, zero, zero)
            for m in range(len(jobs))]


def _masks(jobs: list[Fit], b: pa.RecordBatch, cols: list[str], which) -> np.ndarray:
    """Rows (label, outer, folds from the third column on) that train or judge each model, a column a model."""
    outer = b.column(3).to_numpy(zero_copy_only=False)
    folds = {c: b.column(4 + i).to_numpy(zero_copy_only=False) for i, c in enumerate(cols)}
    seen: dict[tuple, np.ndarray] = {}
    for f in jobs:
        k = (f.outer, f.folds, f.fold)
        if k not in seen:
            seen[k] = which(f, outer, folds)
    return np.stack([seen[f.outer, f.folds, f.fold] for f in jobs], axis=1)


def _l1_step(h: np.ndarray, g: np.ndarray, beta: np.ndarray, l1: np.ndarray, l2: np.ndarray,
             rounds: int = 10, sweeps: int = 10, tol: float = 1e-6) -> np.ndarray:
    """Step towards the minimum of the quadratic model plus penalties, by coordinate descent: rounds over all
    coordinates, between them sweeps over those that aren't zero.  It needn't be exact: the next step starts from a
    new quadratic model."""
    z, hz = beta.copy(), h @ beta
    base, diag = g - hz, np.diag(h).tolist()
    low, pen = (np.diag(h) + l2).tolist(), l1.tolist()

    def sweep(coordinates) -> float:
        big = 0.0
        for j in coordinates:
            if low[j] <= 1e-12:
                continue
            old = float(z[j])
            u = diag[j] * old - float(base[j]) - float(hz[j])
            new = (u - pen[j] if u > pen[j] else u + pen[j] if u < -pen[j] else 0.0) / low[j]
            if new != old:
                np.add(hz, h[j] * (new - old), out=hz)
                z[j] = new
                big = max(big, abs(new - old))
        return big

    for _ in range(rounds):
        if sweep(range(len(z))) < tol * max(1.0, float(np.abs(z).max())):
            break
        active = np.flatnonzero(z).tolist()
        for _ in range(sweeps):
            if sweep(active) < tol * max(1.0, float(np.abs(z).max())):
                break
    return z - beta


def _used(f: Fit, beta: np.ndarray, g: np.ndarray, l1: np.ndarray, l2: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Coordinates that a step may move: all free ones, or with L1 those that aren't zero or that pull nearly as hard as the penalty."""
    if f.l1 == 0:
        return np.flatnonzero(free)
    pull = np.abs(f.C * g + l2 * beta) >= 0.8 * l1
    return np.flatnonzero(free & (pull | (beta != 0)))


def fit_together(d: DataFrame | CellRows, fits: list[Fit], p: int, max_iter: int = 100, tol: float = 1e-5) -> list[Fit]:
    """Fit all models of ``fits`` from their ``beta`` (zeros where None), until each has converged.

    A model stops when a step lowers its objective by less than ``tol`` of it,
    or when no step does; ``converged`` is False where ``max_iter`` came first.
    ``d`` has the columns features, label, outer and the folds, or is the cells of such rows.
    """
    q = p + 1
    pen = np.ones((len(fits), q))
    free = np.ones((len(fits), q), dtype=bool)
    for m, f in enumerate(fits):
        f.beta = np.zeros(q) if f.beta is None else f.beta.astype(float).copy()
        if not f.penalize_intercept:
            pen[m, -1] = 0.0
        if f.keep is not None:
            free[m, :-1] = f.keep
            f.beta[:-1] *= f.keep
        f.converged, f.steps = False, 0
    l1 = pen * np.array([f.l1 for f in fits])[:, None]
    l2 = pen * np.array([f.l2 for f in fits])[:, None]

    def objective(m, val, b):
        return fits[m].C * val + 0.5 * float(np.sum(l2[m] * b * b)) + float(np.sum(l1[m] * np.abs(b)))

    def used(m, g):
        return _used(fits[m], fits[m].beta, g, l1[m], l2[m], free[m])

    live = list(range(len(fits)))
    d = _rows(d, fits)
    change = d.cells.change()

    def passed(models, betas, uses):
        return _pass(d, change, [fits[m] for m in models], betas, uses, free[models], l1[models], l2[models])

    at = dict(enumerate(passed(live, [f.beta for f in fits], None)))
    uses = {m: used(m, at[m][1]) for m in live}
    obj = {m: objective(m, at[m][0], fits[m].beta) for m in live}
    step = {m: 1.0 for m in live}
    for _ in range(max_iter):
        nxt = {}
        for m in live:
            f, use, way = fits[m], uses[m], at[m][2]
            # what the next step may move is guessed from the gradient here; what is missed comes a step later
            nxt[m] = np.union1d(use[(f.beta + way)[use] != 0] if f.l1 > 0 else use, used(m, at[m][1])).astype(int)
        tried = {m: fits[m].beta + step[m] * at[m][2] for m in live}
        got = passed(live, [tried[m] for m in live], [nxt[m] for m in live])
        for m, new in zip(list(live), got, strict=True):
            f = fits[m]
            value = objective(m, new[0], tried[m])
            if value <= obj[m] + 1e-12 * max(1.0, abs(obj[m])):
                gain = (obj[m] - value) / max(1.0, abs(obj[m]))
                f.beta, at[m], obj[m], uses[m] = tried[m], new, value, nxt[m]
                f.steps += 1
                step[m] = 1.0
                missed = np.setdiff1d(used(m, new[1]), uses[m])
                missed = missed[np.abs(f.C * new[1][missed]) > l1[m][missed] * (1 + 1e-3)] if f.l1 > 0 else missed
                f.converged = gain < tol and not len(missed)
            else:
                step[m] *= 0.5
                f.converged = step[m] < 1e-6
            if f.converged:
                live.remove(m)
        if not live:
            break
    return fits


def held_out_runs(d: DataFrame | CellRows, fits: list[Fit]) -> DataFrame:
    """Scores of every model on the rows that judge it, for ``metrics.roc_auc_of_runs``: rows (model, part, x, pos, neg),
    a task's distinct scores of a model in order with the rows of class 1 and 0 at each, packed.  ``model`` is its place in
    ``fits``.  A model's scores are cut into parts of at most about ``RUN`` rows, in order; where, is taken from a sample, and
    no sum depends on it."""
    d, cols, jobs, gamma = _judges(d, fits)
    cells, kept = d.cells, ["label", "outer", *cols]
    alike: dict[tuple, list[int]] = {}
    for m, f in enumerate(jobs):
        alike.setdefault((f.outer, f.folds, f.fold), []).append(m)
    parts = -(-d.count // RUN)
    stride = max(1, d.count // (SAMPLE * max(1, parts)))

    def judged(batches, every=1):
        """(models, classes, scores) of rows that judge the same models, a column a model."""
        seen = 0
        for bits, n, b in blocks(batches, kept):
            if every > 1:
                take = np.arange(-seen % every, len(n), every)
                seen += len(n)
                if not len(take):
                    continue
                n, b = n[take], b.take(pa.array(take))
            y = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            outer = b.column(3).to_numpy(zero_copy_only=False)
            folds = {c: b.column(4 + i).to_numpy(zero_copy_only=False) for i, c in enumerate(cols)}
            score = cells.terms(n) @ coefficients(cells, bits, gamma)
            for key, models in alike.items():
                rows = np.flatnonzero(jobs[models[0]].holds_out(outer, folds))
                if len(rows):
                    yield key, y[rows], score[np.ix_(rows, models)]

    def sampled(batches):
        for key, y, s in judged(batches, stride):
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(alike[key], len(y)), pa.int32()), pa.array(s.ravel())],
                                             names=["model", "score"])

    cuts: dict[int, np.ndarray] = {}
    if parts > 1:
        at = F.percentile_approx("score", [(k + 1) / parts for k in range(parts - 1)])
        for r in d.table(kept).mapInArrow(sampled, "model int, score double").groupBy("model").agg(at.alias("at")).collect():
            v = np.unique(r["at"])
            cuts[r["model"]] = v[~np.isnan(v)]

    def packed(held):
        for key, some in held.items():
            y, s = (np.concatenate(v) for v in zip(*some))
            out = []
            for k, m in enumerate(alike[key]):
                x, at = np.unique(s[:, k], return_inverse=True)
                rows, pos = np.bincount(at, minlength=len(x)), np.bincount(at[y == 1], minlength=len(x))
                ends = [0, *np.searchsorted(x, cuts.get(m, np.empty(0)), side="right").tolist(), len(x)]
                for part, (lo, hi) in enumerate(zip(ends, ends[1:])):
                    if hi > lo:
                        out.append((m, part, x[lo:hi].astype("<f8").tobytes(), pos[lo:hi].astype("<i4").tobytes(),
                                    (rows - pos)[lo:hi].astype("<i4").tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)],
                                             names=["model", "part", "x", "pos", "neg"])

    def work(batches):
        held, size = {}, 0
        for key, y, s in judged(batches):
            held.setdefault(key, []).append((y, s))
            size += s.size
            if size >= HELD:
                yield from packed(held)
                held, size = {}, 0
        yield from packed(held)

    runs = d.table(kept).mapInArrow(work, "model int, part int, x binary, pos binary, neg binary")
    tasks = max(runs.sparkSession.sparkContext.defaultParallelism, -(-len(jobs) * d.count // RUN))
    return runs.repartition(tasks, "model", "part").sortWithinPartitions("model", "part")


def held_out_hits(d: DataFrame | CellRows, fits: list[Fit]) -> list[float]:
    """Share of the rows judging it whose class every model tells (NaN: no rows), counted where the rows are."""
    d, cols, jobs, gamma = _judges(d, fits)
    cells = d.cells

    def work(batches):
        acc = np.zeros((len(jobs), 2))
        for bits, n, b in blocks(batches, ["label", "outer", *cols]):
            y = b.column(2).to_numpy(zero_copy_only=False)[:, None]
            judged = _masks(jobs, b, cols, Fit.holds_out)
            hit = (cells.terms(n) @ coefficients(cells, bits, gamma) > 0) == (y == 1)
            acc += np.stack([(hit & judged).sum(axis=0), judged.sum(axis=0)], axis=1)
        return {"": acc.ravel()}

    got = tree_sums(d.table(["label", "outer", *cols]), work).get("", np.zeros(2 * len(jobs)))
    hits, rows = got.reshape(-1, 2).T
    return [float(h / r) if r else float("nan") for h, r in zip(hits, rows, strict=True)]


def _judges(d: DataFrame | CellRows, fits: list[Fit]) -> tuple[CellRows, list[str], list[Fit], np.ndarray]:
    d = _rows(d, fits)
    jobs = [Fit(f.outer, f.folds, f.fold) for f in fits]
    gamma = d.cells.change().T @ np.stack([f.beta for f in fits], axis=1)
    return d, sorted({f.folds for f in fits if f.folds}), jobs, gamma
