"""Iterative regression imputation of numeric columns.

Chained equations with a Bayesian ridge per column (round-robin, columns
with fewer NULLs first, at most ``max_iter`` rounds, early stop when the
largest row change is below ``tol`` times the largest observed value).

Within one pattern of missing columns every imputed value is a linear map of
the row's observed values, and stays one after every step.  So one pass gives
the Gram matrix of each pattern, and all steps of all rounds follow from
those on the driver: the imputed rows' Gram is T G T'.  A second pass gives
the largest row change of every round, which tells where to stop.  A fit is
three aggregates whatever the number of rounds; ``transform`` is one
projection, a CASE over the patterns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from loanframe.operators.base import FitEstimator, FittedModel

EPS = float(np.finfo(np.float64).eps)


def bayesian_ridge_from_gram(n: float, sx: np.ndarray, sy: float, xtx: np.ndarray,
                             xty: np.ndarray, yty: float, max_iter: int = 300, tol: float = 1e-3,
                             a1: float = 1e-6, a2: float = 1e-6, l1: float = 1e-6,
                             l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """Bayesian ridge (fit_intercept) from sufficient statistics.

    ``sx``/``sy`` are sums, ``xtx``/``xty``/``yty`` raw cross products.
    Returns (coef, intercept).
    """
    xm, ym = sx / n, sy / n
    c_xx = xtx - n * np.outer(xm, xm)
    c_xy = xty - n * xm * ym
    c_yy = yty - n * ym * ym
    p = len(xm)
    if p == 0:
        return np.zeros(0), ym
    ev, vecs = np.linalg.eigh((c_xx + c_xx.T) / 2.0)
    ev = np.clip(ev, 0.0, None)
    vt_xy = vecs.T @ c_xy
    var_y = max(c_yy / n, 0.0)
    alpha, lam = 1.0 / (var_y + EPS), 1.0

    def coef_for(alpha, lam):
        w = vecs @ (vt_xy / (ev + lam / alpha))
        rss = c_yy - 2.0 * w @ c_xy + w @ c_xx @ w
        return w, max(rss, 0.0)

    old = None
    for it in range(max_iter):
        w, rss = coef_for(alpha, lam)
        gamma = float(np.sum(alpha * ev / (lam + alpha * ev)))
        lam = (gamma + 2 * l1) / (float(np.sum(w * w)) + 2 * l2)
        alpha = (n - gamma + 2 * a1) / (rss + 2 * a2)
        if it != 0 and float(np.sum(np.abs(old - w))) < tol:
            break
        old = w.copy()
    w, _ = coef_for(alpha, lam)
    return w, float(ym - xm @ w)


#: Up to so many patterns a transform is one CASE; beyond, the same steps one after another.
CASES = 256


def _mask(cols: list[str]) -> Column:
    """Pattern of a row: the i-th character is 1 where column i is NULL."""
    return F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in cols])


def _start(pattern: str) -> np.ndarray:
    """Map of a pattern before any step: rows are columns, the first column is the constant; NULLs start at 0."""
    t = np.zeros((len(pattern), len(pattern) + 1))
    for i, m in enumerate(pattern):
        t[i, i + 1] = m == "0"
    return t


def _step(t: np.ndarray, pattern: str, j: int, w: np.ndarray, b: float) -> None:
    """Apply a fitted step: where j is NULL it becomes w . z + b."""
    if pattern[j] == "1":
        new = w @ t
        new[0] += b
        t[j] = new


def _linear(row: np.ndarray, x: list[Column]) -> Column:
    out = F.lit(float(row[0]))
    for k, v in enumerate(row[1:]):
        if v != 0.0:
            out = out + x[k] * F.lit(float(v))
    return out


class IterativeImputerModel(FittedModel):
    def apply(self, df, state):
        cols, means = self.input_cols(), state["means"]
        live = [i for i, m in enumerate(means) if m is not None]
        p = len(cols)
        shift = [m if m is not None else 0.0 for m in means]
        z = [F.col(f"`{c}`").cast("double") - F.lit(shift[i]) for i, c in enumerate(cols)]
        steps = [(st["j"], np.array(st["coef"]),
                  st["intercept"] - shift[st["j"]] + float(np.dot(st["coef"], shift))) for st in state["steps"]]
        if 2 ** len(live) > CASES:
            return self._chain(df, cols, live, shift, steps)
        out = {}
        maps = {}
        for bits in range(2 ** len(live)):
            pattern = "".join("1" if i in live and bits >> live.index(i) & 1 else "0" for i in range(p))
            maps[pattern] = _start(pattern)
            for j, w, b in steps:
                _step(maps[pattern], pattern, j, w, b)
        dead = [i for i in range(p) if i not in live]
        mask = F.concat(*[F.lit("0") if i in dead else F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0")
                          for i, c in enumerate(cols)])
        d = df.withColumn("__pattern", mask)
        for i in live:
            value = None
            for pattern, t in maps.items():
                if pattern[i] == "1":
                    e = _linear(t[i], z) + F.lit(shift[i])
                    value = F.when(F.col("__pattern") == pattern, e) if value is None else value.when(
                        F.col("__pattern") == pattern, e)
            out[cols[i]] = F.when(F.col(f"`{cols[i]}`").isNull(), value).otherwise(F.col(f"`{cols[i]}`").cast("double"))
        return d.withColumns(out).drop("__pattern")

    @staticmethod
    def _chain(df, cols, live, shift, steps):
        d = df.withColumns({f"__m{i}": F.col(f"`{cols[i]}`").isNull() for i in live})
        d = d.withColumns({f"__z{i}": F.coalesce(F.col(f"`{cols[i]}`").cast("double") - F.lit(shift[i]), F.lit(0.0)) for i in live})
        zs = {i: F.col(f"__z{i}") for i in live}
        for j, w, b in steps:
            row = np.concatenate([[b], [w[i] for i in live]])
            d = d.withColumn(f"__z{j}", F.when(F.col(f"__m{j}"), _linear(row, list(zs.values()))).otherwise(zs[j]))
        d = d.withColumns({cols[i]: zs[i] + F.lit(shift[i]) for i in live})
        return d.drop(*[f"__{k}{i}" for i in live for k in "mz"])


class IterativeImputer(FitEstimator):
    """``IterativeImputer(max_iter=10)`` with a Bayesian ridge per column."""
    model_class = IterativeImputerModel

    def __init__(self, inputCols=None, max_iter: int = 10, tol: float = 1e-3):
        super().__init__(inputCols, max_iter=max_iter, tol=tol)

    def fit_state(self, df, cols, opts):
        p = len(cols)
        x = [F.col(f"`{c}`").cast("double") for c in cols]
        r1 = df.agg(F.count(F.lit(1)).alias("_rows"),
                    *[F.avg(xi).alias(f"_m{i}") for i, xi in enumerate(x)],
                    *[F.count_if(xi.isNull()).alias(f"_z{i}") for i, xi in enumerate(x)],
                    *[F.max(F.abs(xi)).alias(f"_a{i}") for i, xi in enumerate(x)]).first()
        means = [r1[f"_m{i}"] for i in range(p)]
        nulls = [r1[f"_z{i}"] for i in range(p)]
        max_abs = max([r1[f"_a{i}"] or 0.0 for i in range(p)] + [0.0])
        live = [i for i in range(p) if means[i] is not None]  # all-NULL columns are left out
        state = {"means": means, "steps": [], "rounds": 0}
        rounds = int(opts.get("max_iter", 10))
        if not live or rounds == 0:
            return state
        shift = np.array([means[i] for i in live])
        names = [cols[i] for i in live]
        q = len(live)
        # Gram of (1, z) for every pattern, z shifted by the means (for precision) and 0 where NULL
        z = [F.lit(1.0), *[F.coalesce(x[i] - F.lit(float(means[i])), F.lit(0.0)) for i in live]]
        rows = df.groupBy(_mask(names).alias("pattern")).agg(
            *[F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i in range(q + 1) for j in range(i, q + 1)]).collect()
        grams = {}
        for r in rows:
            g = np.zeros((q + 1, q + 1))
            for i in range(q + 1):
                for j in range(i, q + 1):
                    g[i, j] = g[j, i] = r[f"g{i}_{j}"]
            grams[r["pattern"]] = g
        maps = {pattern: _start(pattern) for pattern in grams}
        order = sorted(range(q), key=lambda i: (nulls[live[i]], i))
        steps: list[tuple[int, np.ndarray, float]] = []
        after = [{k: t.copy() for k, t in maps.items()}]
        one = np.eye(1, q + 1)
        for _ in range(rounds):
            for j in order:
                full = np.zeros((q + 1, q + 1))              # Gram of (1, imputed z) where j is observed
                for pattern, g in grams.items():
                    if pattern[j] == "0":
                        t = np.vstack([one, maps[pattern]])
                        full += t @ g @ t.T
                others = [k for k in range(q) if k != j]
                at = np.array(others, dtype=int) + 1
                w, b = bayesian_ridge_from_gram(full[0, 0], full[0, at], full[0, j + 1], full[np.ix_(at, at)],
                                                full[at, j + 1], full[j + 1, j + 1])
                coef = np.zeros(q)
                coef[others] = w
                steps.append((j, coef, b))
                for pattern in maps:
                    _step(maps[pattern], pattern, j, coef, b)
            after.append({k: t.copy() for k, t in maps.items()})
        # largest row sum of |change| in every round, all rounds in one pass
        tol = float(opts.get("tol", 1e-3)) * max_abs
        worst = []
        for k in range(1, rounds + 1):
            value = None
            for pattern in grams:
                delta = after[k][pattern] - after[k - 1][pattern]
                if np.any(delta):
                    change = sum((F.abs(_linear(delta[i], z[1:])) for i in range(q) if np.any(delta[i])), F.lit(0.0))
                    value = (F.when(F.col("__pattern") == pattern, change) if value is None
                             else value.when(F.col("__pattern") == pattern, change))
            worst.append(F.max(value if value is not None else F.lit(0.0)).alias(f"r{k}"))
        top = df.withColumn("__pattern", _mask(names)).agg(*worst).first()
        done = next((k for k in range(1, rounds + 1) if (top[f"r{k}"] or 0.0) < tol), rounds)
        state["rounds"] = done
        for j, coef, b in steps[:done * q]:
            full = [0.0] * p
            for k in range(q):
                full[live[k]] = float(coef[k])
            state["steps"].append({"j": live[j], "coef": full, "intercept": float(shift[j] + b - coef @ shift)})
        return state
