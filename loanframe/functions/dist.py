"""Distribution functions.

* the inverse normal CDF (Wichura 1988, algorithm AS241) both as numpy and as
  SQL text that Spark and DuckDB run alike, so quantile and Q-Q work stays a
  JVM column expression;
* tails of the t, chi-square and normal laws for the p-values of the tests.
  The statistics are always computed by Spark; these turn a small table of
  statistics into p-values (on the driver or in a pandas UDF).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Coefficients of algorithm AS241 (PPND16), Wichura 1988.
_A = [3.387132872796366608, 133.14166789178437745, 1971.5909503065514427,
      13731.693765509461125, 45921.953931549871457, 67265.770927008700853,
      33430.575583588128105, 2509.0809287301226727]
_B = [1.0, 42.313330701600911252, 687.1870074920579083, 5394.1960214247511077,
      21213.794301586595867, 39307.89580009271061, 28729.085735721942674,
      5226.495278852545925]
_C = [1.42343711074968357734, 4.6303378461565452959, 5.7694972214606914055,
      3.64784832476320460504, 1.27045825245236838258, 0.24178072517745061177,
      0.0227238449892691845833, 7.7454501427834140764e-4]
_D = [1.0, 2.05319162663775882187, 1.6763848301838038494, 0.68976733498510000455,
      0.14810397642748007459, 0.0151986665636164571966, 5.475938084995344946e-4,
      1.05075007164441684324e-9]
_E = [6.6579046435011037772, 5.4637849111641143699, 1.7848265399172913358,
      0.29656057182850489123, 0.026532189526576123093, 0.0012426609473880784386,
      2.71155556874348757815e-5, 2.01033439929228813265e-7]
_F = [1.0, 0.59983220655588793769, 0.13692988092273580531, 0.0148753612908506148525,
      7.868691311456132591e-4, 1.8463183175100546818e-5, 1.4215117583164458887e-7,
      2.04426310338993978564e-15]


def _horner_np(coefs, x):
    acc = np.zeros_like(x) + coefs[-1]
    for c in reversed(coefs[:-1]):
        acc = acc * x + c
    return acc


def norm_ppf(p) -> np.ndarray:
    """Inverse standard normal CDF (AS241), vectorised."""
    p = np.asarray(p, dtype=float)
    q = p - 0.5
    out = np.empty_like(p)
    central = np.abs(q) <= 0.425
    r = 0.180625 - q * q
    out[central] = (q * _horner_np(_A, r) / _horner_np(_B, r))[central]
    tail = ~central
    rr = np.where(q < 0, p, 1.0 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        rr = np.sqrt(-np.log(rr))
    near = tail & (rr <= 5.0)
    far = tail & (rr > 5.0)
    v_near = _horner_np(_C, rr - 1.6) / _horner_np(_D, rr - 1.6)
    v_far = _horner_np(_E, rr - 5.0) / _horner_np(_F, rr - 5.0)
    v = np.where(near, v_near, v_far)
    v = np.where(q < 0, -v, v)
    out[tail] = v[tail]
    out[p <= 0] = -np.inf
    out[p >= 1] = np.inf
    return out


def _num(v: float) -> str:
    # exponent form: a DOUBLE literal in both Spark SQL and DuckDB (not DECIMAL)
    return f"{float(v):.17e}"


def _horner_sql(coefs, x: str) -> str:
    acc = _num(coefs[-1])
    for c in reversed(coefs[:-1]):
        acc = f"(({acc}) * {x} + {_num(c)})"
    return acc


def norm_ppf_sql(p: str) -> str:
    """AS241 as SQL text; identical in Spark SQL and DuckDB.

    ``p`` must be a SQL expression in (0, 1).  The three branches are plain
    CASE arms, so the whole thing stays inside whole-stage codegen.
    """
    q = f"(CAST({p} AS DOUBLE) - {_num(0.5)})"
    r = f"({_num(0.180625)} - {q} * {q})"
    rt = f"sqrt(-ln(CASE WHEN {q} < 0 THEN CAST({p} AS DOUBLE) ELSE {_num(1.0)} - CAST({p} AS DOUBLE) END))"
    near = f"({_horner_sql(_C, f'({rt} - {_num(1.6)})')} / {_horner_sql(_D, f'({rt} - {_num(1.6)})')})"
    far = f"({_horner_sql(_E, f'({rt} - {_num(5.0)})')} / {_horner_sql(_F, f'({rt} - {_num(5.0)})')})"
    tail = f"(CASE WHEN {rt} <= {_num(5.0)} THEN {near} ELSE {far} END)"
    return (f"(CASE WHEN abs({q}) <= {_num(0.425)} THEN {q} * {_horner_sql(_A, r)} / {_horner_sql(_B, r)}"
            f" WHEN {q} < 0 THEN -{tail} ELSE {tail} END)")


def norm_ppf_col(p: Column | str) -> Column:
    """AS241 as a Spark column expression (subexpression elimination keeps
    the input evaluated once inside codegen)."""
    return _ppf_column(F.col(p) if isinstance(p, str) else p)


def _ppf_column(x: Column) -> Column:
    """AS241 built from Column objects (used inside ``transform``)."""
    def horner(coefs, v):
        acc = F.lit(float(coefs[-1]))
        for c in reversed(coefs[:-1]):
            acc = acc * v + F.lit(float(c))
        return acc
    q = x - F.lit(0.5)
    r = F.lit(0.180625) - q * q
    rt = F.sqrt(-F.log(F.when(q < 0, x).otherwise(F.lit(1.0) - x)))
    near = horner(_C, rt - F.lit(1.6)) / horner(_D, rt - F.lit(1.6))
    far = horner(_E, rt - F.lit(5.0)) / horner(_F, rt - F.lit(5.0))
    tail = F.when(rt <= 5.0, near).otherwise(far)
    return (F.when(F.abs(q) <= 0.425, q * horner(_A, r) / horner(_B, r))
            .when(q < 0, -tail).otherwise(tail))


def norm_cdf(x) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    return 0.5 * np.vectorize(math.erfc)(-x / math.sqrt(2.0))


def norm_sf(x) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    return 0.5 * np.vectorize(math.erfc)(x / math.sqrt(2.0))


# --- incomplete beta and gamma (continued fractions, Lentz's method) -------

_EPS = 1e-15
_TINY = 1e-300


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if not (x == x) or not (a == a) or not (b == b):
        return float("nan")
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if not (x == x) or not (a == a):
        return float("nan")
    if x <= 0.0:
        return 1.0
    if math.isinf(x):
        return 0.0
    gln = math.lgamma(a)
    if x < a + 1.0:
        ap, s, term = a, 1.0 / a, 1.0 / a
        for _ in range(100000):
            ap += 1.0
            term *= x / ap
            s += term
            if abs(term) < abs(s) * _EPS:
                break
        return 1.0 - s * math.exp(-x + a * math.log(x) - gln)
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = d if abs(d) > _TINY else _TINY
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


def t_sf2(t: float, dof: float) -> float:
    """Two-sided p-value of a t statistic."""
    if t is None or dof is None or not (t == t) or not (dof == dof) or dof <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def chi2_sf(x: float, k: float) -> float:
    if x is None or k is None or not (x == x) or not (k == k) or k <= 0:
        return float("nan")
    return gammaincc(k / 2.0, x / 2.0)


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided Welch / Student p-value as an Arrow-batched column."""
    return pd.Series([t_sf2(float(a), float(b)) if pd.notna(a) and pd.notna(b) else float("nan")
                      for a, b in zip(t, dof)], dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(a), float(b)) if pd.notna(a) and pd.notna(b) else float("nan")
                      for a, b in zip(x, k)], dtype="float64")
