"""Numeric transforms (I3-I10), fitted on train, applied as expressions.

Every ``fit`` is one (or, for Yeo-Johnson, four) aggregate passes that
return a few constants per column; every ``transform`` is a projection.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanframe.functions.dist import norm_ppf, norm_ppf_col
from loanframe.operators.base import FitEstimator, FittedModel, StatelessTransformer
from loanframe.operators.outliers import quantiles

# ------------------------------------------------------------------ I5 / I6


class MinMaxScalerModel(FittedModel):
    def apply(self, df, state):
        out = {}
        for c in self.input_cols():
            lo, hi = state["min"][c], state["max"][c]
            if lo is None:
                continue
            rng = (hi - lo) or 1.0  # constant column -> 0
            out[c] = (F.col(c) - F.lit(lo)) / F.lit(rng)
        return df.withColumns(out)


class MinMaxScaler(FitEstimator):
    """(x - min) / (max - min); a constant column maps to 0."""
    model_class = MinMaxScalerModel

    def fit_state(self, df, cols, opts):
        r = df.agg(*[F.min(F.col(c).cast("double")).alias(f"_a{i}") for i, c in enumerate(cols)],
                   *[F.max(F.col(c).cast("double")).alias(f"_b{i}") for i, c in enumerate(cols)]).first()
        return {"min": {c: r[f"_a{i}"] for i, c in enumerate(cols)},
                "max": {c: r[f"_b{i}"] for i, c in enumerate(cols)}}


class StandardScalerModel(FittedModel):
    def apply(self, df, state):
        arr = self.opts().get("array_col")
        if arr:
            mean = F.array(*[F.lit(float(v)) for v in state["mean"]])
            sd = F.array(*[F.lit(float(v)) for v in state["scale"]])
            return df.withColumn(arr, F.transform(F.col(arr), lambda x, i: (x - mean[i]) / sd[i]))
        return df.withColumns({c: (F.col(c) - F.lit(state["mean"][c])) / F.lit(state["scale"][c])
                               for c in self.input_cols() if state["mean"][c] is not None})


class StandardScaler(FitEstimator):
    """(x - mean) / population sd; a constant column divides by 1.

    Works on named columns (one aggregate) or on an ``array_col`` of
    features (one ``Summarizer`` pass over the vector, JVM side).
    """
    model_class = StandardScalerModel

    def __init__(self, inputCols=None, array_col: str | None = None):
        super().__init__(inputCols, array_col=array_col)

    def fit_state(self, df, cols, opts):
        arr = opts.get("array_col")
        if arr:
            s = df.select(Summarizer.metrics("mean", "variance", "count").summary(
                array_to_vector(F.col(arr))).alias("s")).first()["s"]
            n = s["count"]
            mean = s["mean"].toArray()
            var = s["variance"].toArray() * ((n - 1) / n if n > 1 else 0.0)
            scale = [math.sqrt(v) if v > 0 else 1.0 for v in var]
            return {"mean": [float(v) for v in mean], "scale": scale}
        r = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_m{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(F.col(c).cast("double")).alias(f"_s{i}")
                     for i, c in enumerate(cols)]).first()
        return {"mean": {c: r[f"_m{i}"] for i, c in enumerate(cols)},
                "scale": {c: (r[f"_s{i}"] or 1.0) for i, c in enumerate(cols)}}


# ------------------------------------------------------------------ I7 / I8

def bin_code(x: Column, inner_edges: list[float]) -> Column:
    """Number of inner edges <= x (searchsorted side='right')."""
    code = F.lit(0.0)
    for e in inner_edges:
        code = code + F.when(x >= F.lit(e), 1.0).otherwise(0.0)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(code)


def merge_edges(edges: list[float], tol: float = 1e-8) -> list[float]:
    """Drop edges closer than ``tol`` to the one before (bins of width 0)."""
    out = []
    for e in edges:
        if not out or e - out[-1] > tol:
            out.append(e)
    return out


class KBinsDiscretizerModel(FittedModel):
    def apply(self, df, state):
        return df.withColumns({c: bin_code(F.col(c), state["edges"][c][1:-1])
                               for c in self.input_cols() if state["edges"][c]})


class KBinsDiscretizer(FitEstimator):
    """Equal-frequency bins with ordinal codes.  Edges are exact
    interpolated percentiles; equal edges merge."""
    model_class = KBinsDiscretizerModel

    def __init__(self, inputCols=None, n_bins: int = 3):
        super().__init__(inputCols, n_bins=n_bins)

    def fit_state(self, df, cols, opts):
        k = int(opts.get("n_bins", 3))
        probs = [i / k for i in range(k + 1)]
        q = quantiles(df, cols, probs)
        return {"edges": {c: (merge_edges(v) if v[0] is not None else []) for c, v in q.items()}}


class Binarizer(StatelessTransformer):
    """I8: 1.0 where x > threshold, else 0.0 (NULL stays NULL)."""

    def __init__(self, inputCols=None, threshold: float = 0.0):
        super().__init__(inputCols, threshold=threshold)

    def apply(self, df):
        t = float(self.opts().get("threshold", 0.0))
        return df.withColumns({c: F.when(F.col(c).isNull(), F.lit(None).cast("double"))
                               .otherwise((F.col(c) > F.lit(t)).cast("double"))
                               for c in self.input_cols()})


# ------------------------------------------------------------------ I9 / I10

def polynomial_terms(names: list[str], interaction_only: bool) -> list[tuple[str, tuple[int, ...]]]:
    """Degree-2 terms in the cited order: xi, then xi*xj for i <= j (i < j
    when ``interaction_only``); names ``a``, ``a^2``, ``a b``."""
    terms = [(n, (i,)) for i, n in enumerate(names)]
    p = len(names)
    for i in range(p):
        for j in range(i if not interaction_only else i + 1, p):
            name = f"{names[i]}^2" if i == j else f"{names[i]} {names[j]}"
            terms.append((name, (i, j)))
    return terms


class PolynomialFeatures(StatelessTransformer):
    """Degree-2 features of ``inputCols``.

    ``output_col`` set: one ``array<double>`` column in term order (for many
    features: keeps the row narrow for codegen); otherwise named columns.
    """

    def __init__(self, inputCols=None, interaction_only: bool = False, output_col: str | None = None):
        super().__init__(inputCols, interaction_only=interaction_only, output_col=output_col)

    def terms(self):
        return polynomial_terms(self.input_cols(), bool(self.opts().get("interaction_only")))

    def output_cols(self):
        return [n for n, _ in self.terms()]

    def apply(self, df):
        cols = self.input_cols()
        out = self.opts().get("output_col")
        keep = [F.col(f"`{c}`") for c in df.columns if c not in set(cols)]
        x = [F.col(f"`{c}`").cast("double") for c in cols]
        if out:
            return df.select(*keep, F.array(*x).alias(out)).withColumn(
                out, products(F.col(out), len(cols), bool(self.opts().get("interaction_only"))))
        exprs = [(name, x[idx[0]] if len(idx) == 1 else x[idx[0]] * x[idx[1]]) for name, idx in self.terms()]
        return df.select(*keep, *[e.alias(n) for n, e in exprs])


def products(z: Column, width: int, interaction_only: bool) -> Column:
    """An array and the products of its elements in term order: one expression of any width."""
    if not width:
        return z
    start = 2 if interaction_only else 1
    rows = F.transform(z, lambda x, i: F.transform(F.slice(z, i + start, width), lambda y: x * y))
    return F.concat(z, F.flatten(rows))


class Assemble(StatelessTransformer):
    """Glue (L6): the named feature columns, in order, into one array column."""

    def __init__(self, inputCols=None, output_col: str = "features", keep: list[str] | None = None):
        super().__init__(inputCols, output_col=output_col, keep=keep or [])

    def apply(self, df):
        o = self.opts()
        arr = F.array(*[F.col(f"`{c}`").cast("double") for c in self.input_cols()])
        return df.select(*[F.col(f"`{c}`") for c in o.get("keep", [])], arr.alias(o["output_col"]))


# ------------------------------------------------------------------ I3


def yeo_johnson(x: Column, lam) -> Column:
    """Yeo-Johnson transform; ``lam`` a number or a column."""
    if isinstance(lam, (int, float)):
        lam_c, is0, is2 = F.lit(float(lam)), abs(lam) < 1e-12, abs(lam - 2.0) < 1e-12
        p = F.log1p(x) if is0 else (F.pow(x + 1.0, lam_c) - 1.0) / lam_c
        n = -F.log1p(-x) if is2 else -(F.pow(F.lit(1.0) - x, F.lit(2.0) - lam_c) - 1.0) / (F.lit(2.0) - lam_c)
    else:
        lam_c = lam
        p = F.when(F.abs(lam_c) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1.0, lam_c) - 1.0) / lam_c)
        n = F.when(F.abs(lam_c - 2.0) < 1e-12, -F.log1p(-x)).otherwise(
            -(F.pow(F.lit(1.0) - x, F.lit(2.0) - lam_c) - 1.0) / (F.lit(2.0) - lam_c))
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x >= 0, p).otherwise(n)


def _psi(x: np.ndarray, log: np.ndarray, lam: float) -> np.ndarray:
    """Yeo-Johnson of ``x``; ``log`` is sign(x) log(1 + |x|)."""
    out = np.empty_like(x)
    up = x >= 0
    out[up] = log[up] if abs(lam) < 1e-12 else np.expm1(lam * log[up]) / lam
    down = ~up
    out[down] = log[down] if abs(lam - 2.0) < 1e-12 else -np.expm1((2.0 - lam) * -log[down]) / (2.0 - lam)
    return out


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (n, mean, sum of squares about it, sum of logs) of two parts taken together."""
    n = np.maximum(a[:, 0] + b[:, 0], 1.0)
    gap = b[:, 1] - a[:, 1]
    return np.stack([a[:, 0] + b[:, 0], a[:, 1] + gap * b[:, 0] / n, a[:, 2] + b[:, 2] + gap * gap * a[:, 0] * b[:, 0] / n,
                     a[:, 3] + b[:, 3]], axis=1)


#: Tasks that join the moments of all others.
_MERGERS = 16


def yj_loglik(df: DataFrame, grids: dict[str, list[float]]) -> dict[str, list[tuple[float, float]]]:
    """(candidate, log-likelihood) of every candidate lambda of every column, in one pass; without those that overflow.

    A task reads its rows as they are and holds four moments a candidate; tasks are joined
    by a few, these by the driver.
    """
    cols = list(grids)
    jobs = [(c, lam) for c in range(len(cols)) for lam in grids[cols[c]]]
    form = "merger int, v binary"

    def blob(v: np.ndarray, merger: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([merger], pa.int32()), pa.array([v.astype("<f8").tobytes()], pa.binary())],
                                          names=["merger", "v"])

    def task(batches):
        acc = np.zeros((len(jobs), 4))
        for b in batches:
            here = np.zeros((len(jobs), 4))
            x = [col.to_numpy(zero_copy_only=False) for col in b.columns]
            x = [v[~np.isnan(v)] for v in x]
            logs = [np.sign(v) * np.log1p(np.abs(v)) for v in x]
            with np.errstate(all="ignore"):
                for m, (c, lam) in enumerate(jobs):
                    if len(x[c]):
                        psi = _psi(x[c], logs[c], lam)
                        mean = psi.mean()
                        here[m] = len(psi), mean, np.sum((psi - mean) ** 2), logs[c].sum()
                acc = _joint(acc, here)
        yield blob(acc, TaskContext.get().partitionId() % _MERGERS)

    def join(blobs) -> np.ndarray:
        acc = np.zeros((len(jobs), 4))
        with np.errstate(all="ignore"):
            for v in blobs:
                acc = _joint(acc, np.frombuffer(v, "<f8").reshape(-1, 4))
        return acc

    def merger(batches):
        yield blob(join(v for b in batches for v in b.column(1).to_pylist()), 0)

    src = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    found = join(src.mapInArrow(task, form).repartition(_MERGERS, "merger").mapInArrow(merger, form).toArrow()["v"].to_pylist())
    out: dict[str, list[tuple[float, float]]] = {c: [] for c in cols}
    for (c, lam), (n, _, squares, logs) in zip(jobs, found.tolist(), strict=True):
        v = squares / n if n else 0.0
        if 0 < v < math.inf:
            out[cols[c]].append((lam, -n / 2.0 * math.log(v) + (lam - 1.0) * logs))
    return out


class YeoJohnsonModel(FittedModel):
    def apply(self, df, state):
        return df.withColumns({c: yeo_johnson(F.col(c).cast("double"), state["lambdas"][c])
                               for c in self.input_cols()})


class YeoJohnson(FitEstimator):
    """Yeo-Johnson power transform, lambda by maximum likelihood.

    Log-likelihood -n/2 ln var(psi) + (lambda-1) sum sign(x) log1p|x| for
    21 candidate lambdas of all columns in one pass.  The bracket moves on
    while the best is at its edge, and is then cut to its best twentieth
    ``refine`` times; the parabola through the last three points gives the
    maximum.  No standardising.  A candidate whose variance overflows loses.
    """
    model_class = YeoJohnsonModel

    def __init__(self, inputCols=None, lo: float = -5.0, hi: float = 5.0, steps: int = 21,
                 refine: int = 3):
        super().__init__(inputCols, lo=lo, hi=hi, steps=steps, refine=refine)

    def fit_state(self, df, cols, opts):
        steps = int(opts.get("steps", 21))
        grids = {c: [float(v) for v in np.linspace(opts.get("lo", -5.0), opts.get("hi", 5.0), steps)]
                 for c in cols}
        best: dict[str, float] = {c: 1.0 for c in cols}
        left = {c: 1 + int(opts.get("refine", 3)) for c in cols}
        while any(left.values()):
            open_ = [c for c in cols if left[c]]
            found = yj_loglik(df, {c: grids[c] for c in open_})
            for c in open_:
                cand = sorted(found[c])
                lams = grids[c]
                step = lams[1] - lams[0]
                if not cand:
                    left[c] = 0
                    continue
                k = max(range(len(cand)), key=lambda i: cand[i][1])
                best[c] = float(cand[k][0])
                if 0 < k < len(cand) - 1:
                    left[c] -= 1
                    if not left[c]:
                        lo, mid, hi = (cand[i][1] for i in (k - 1, k, k + 1))
                        if lo + hi < 2 * mid:
                            best[c] += 0.5 * step * (lo - hi) / (lo - 2 * mid + hi)
                    half = step
                elif len(cand) < len(lams) or abs(best[c]) > 1e6:
                    left[c] -= 1                            # beyond lies overflow
                    half = step
                else:
                    half = (lams[-1] - lams[0]) / 2
                grids[c] = [float(v) for v in np.linspace(best[c] - half, best[c] + half, steps)]
        return {"lambdas": best}


# ------------------------------------------------------------------ I4

def _numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _ranks(x: Column, knots: list[float]) -> tuple[Column, Column]:
    """How many knots are below ``x``, and how many are not above it."""
    return F.size(F.filter(_numbers(knots), lambda k: k < x)), F.size(F.filter(_numbers(knots), lambda k: k <= x))


def interp_cols(x: Column, below: Column, upto: Column, xp: list[float], fp: list[float]) -> tuple[Column, Column]:
    """np.interp of ``x`` between knots as a column, from the left (of equal knots the last counts) and from the right
    (the first counts), given how many knots are below ``x`` and how many are not above it.

    Three look-ups in arrays a value, whatever the number of knots.
    """
    slope = _numbers([(g - f) / (r - q) if r > q else 0.0 for q, r, f, g in zip(xp, xp[1:], fp, fp[1:])])
    knots, refs, n = _numbers(xp), _numbers(fp), len(xp)

    def at(knot: Column, piece: Column) -> Column:
        return F.get(refs, knot) + (x - F.get(knots, knot)) * F.get(slope, piece)

    def ends(count: Column, inner: Column) -> Column:
        return F.when(count == 0, F.lit(float(fp[0]))).when(count == n, F.lit(float(fp[-1]))).otherwise(inner)
    return ends(upto, at(upto - 1, upto - 1)), ends(below, at(below, below - 1))


BOUNDS = 1e-7


class QuantileTransformerModel(FittedModel):
    def apply(self, df, state):
        out, counts = {}, {}
        refs = state["references"]
        normal = self.opts().get("output_distribution", "normal") == "normal"
        fitted = [c for c in self.input_cols() if state["quantiles"][c] is not None]
        for i, c in enumerate(fitted):
            x = F.col(f"`{c}`").cast("double")
            counts[f"_below{i}"], counts[f"_upto{i}"] = _ranks(x, state["quantiles"][c])
        names = df.columns
        df = df.withColumns(counts)                             # a projection of its own: each count is used many times
        for i, c in enumerate(fitted):
            q = state["quantiles"][c]
            x = F.col(f"`{c}`").cast("double")
            fwd, bwd = interp_cols(x, F.col(f"_below{i}"), F.col(f"_upto{i}"), q, refs)
            u = F.lit(0.5) * (fwd + bwd)
            if normal:
                lo_hit, hi_hit = x - BOUNDS < F.lit(q[0]), x + BOUNDS > F.lit(q[-1])
            else:
                lo_hit, hi_hit = x == F.lit(q[0]), x == F.lit(q[-1])
            out[c] = F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
                F.when(hi_hit, 1.0).when(lo_hit, 0.0).otherwise(u))
        d = df.withColumns(out).select(*[F.col(f"`{c}`") for c in names])
        if not normal:
            return d
        # the uniform value is its own projection: the inverse normal uses it
        # many times, and must not copy the interpolation tree into each use
        clip = float(norm_ppf(np.array([BOUNDS - np.spacing(1)]))[0])
        fin = {}
        for c in out:
            u = F.col(c)
            z = F.when(u <= 0.0, F.lit(clip)).when(u >= 1.0, F.lit(-clip)).otherwise(norm_ppf_col(u))
            # greatest and least skip NULLs: a NULL stays NULL
            fin[c] = F.when(u.isNotNull(), F.least(F.greatest(z, F.lit(clip)), F.lit(-clip)))
        return d.withColumns(fin)


class QuantileTransformer(FitEstimator):
    """I4: map through the empirical CDF at ``n_quantiles`` knots (exact,
    interpolated percentiles), then to the normal law with AS241."""
    model_class = QuantileTransformerModel

    def __init__(self, inputCols=None, n_quantiles: int = 100, output_distribution: str = "normal"):
        super().__init__(inputCols, n_quantiles=n_quantiles, output_distribution=output_distribution)

    def fit_state(self, df, cols, opts):
        k = int(opts.get("n_quantiles", 100))
        refs = [float(v) for v in np.linspace(0.0, 1.0, k)]
        q = quantiles(df, cols, refs)
        out = {}
        for c, v in q.items():
            out[c] = None if v[0] is None else [float(a) for a in np.maximum.accumulate(v)]
        return {"references": refs, "quantiles": out}
