import math

import numpy as np
from pyspark.sql import functions as F

from loanframe.operators import stattests as T


def test_welch_closed_form(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0]
    rows = [(x, False) for x in a] + [(x, True) for x in b]
    df = spark.createDataFrame(rows, "x double, g boolean")
    r = T.welch_t_tests(df, ["x"], ["g"]).first()
    va, vb = np.var(a, ddof=1), np.var(b, ddof=1)
    t = (np.mean(a) - np.mean(b)) / math.sqrt(va / 4 + vb / 3)
    dof = (va / 4 + vb / 3) ** 2 / ((va / 4) ** 2 / 3 + (vb / 3) ** 2 / 2)
    assert abs(r["t_stat"] - t) < 1e-12 and abs(r["dof"] - dof) < 1e-9
    assert 0 < r["p_value"] < 1


def test_chi2_yates_2x2(spark):
    # 2x2 table [[10, 20], [30, 40]]; Yates-corrected statistic by hand
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 40
    df = spark.createDataFrame(rows, "r string, c string")
    r = T.chi2_independence(df, ["r"], ["c"]).first()
    obs = np.array([[10, 20], [30, 40]], float)
    exp = obs.sum(1)[:, None] * obs.sum(0)[None, :] / obs.sum()
    stat = (((np.abs(obs - exp) - 0.5) ** 2) / exp).sum()
    assert r["dof"] == 1 and abs(r["statistic"] - stat) < 1e-9


def test_shapiro_normal_vs_skewed(spark):
    rng = np.random.default_rng(0)
    normal = spark.createDataFrame([(float(v),) for v in rng.normal(size=400)], "x double")
    skewed = spark.createDataFrame([(float(v),) for v in rng.exponential(size=400)], "x double")
    a, b = T.shapiro_wilk(normal, "x"), T.shapiro_wilk(skewed, "x")
    assert a["W"] > 0.98 and a["p_value"] > 0.01
    assert b["W"] < a["W"] and b["p_value"] < 1e-6


def test_little_mcar_random_vs_dependent(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    y = x + rng.normal(size=3000)
    rand = [(float(a), None if rng.random() < 0.2 else float(b)) for a, b in zip(x, y)]
    dep = [(float(a), None if a > 0.5 else float(b)) for a, b in zip(x, y)]
    r1 = T.little_mcar(spark.createDataFrame(rand, "x double, y double"), ["x", "y"])
    r2 = T.little_mcar(spark.createDataFrame(dep, "x double, y double"), ["x", "y"])
    assert r1["p_value"] > 0.001 and r2["p_value"] < 1e-6 and r2["dof"] == 1


def test_contingency_skips_nulls_per_pair(spark):
    df = spark.createDataFrame([("a", None, "u"), ("b", "x", "v")], "r string, c string, d string")
    ct = T.contingency_long(df, ["r"], ["c", "d"])
    got = {(x["col_var"], x["row_level"]) for x in ct.collect()}
    assert got == {("c", "b"), ("d", "a"), ("d", "b")}


def test_sums_of_normal_scores_beyond_the_tail():
    """Prefix sums by integral agree with the scores added up, for even and odd n."""
    from loanframe.functions.dist import norm_ppf
    for n in (5, 6, 40_000, 60_001):
        m = norm_ppf((np.arange(1, n + 1) - 0.375) / (n + 0.25))
        s = T.ScoreSums(n)
        upto = np.concatenate([[0.0], np.cumsum(m)])
        assert np.abs(s.upto(np.arange(n + 1)) - upto).max() < 1e-8
        assert abs(s.squares - float(np.sum(m * m))) < 1e-9 * n


def test_little_mcar_of_many_columns(spark):
    """More columns than a bitmask of an int holds; without NULLs there is one pattern and nothing to test."""
    cols = [f"c{i}" for i in range(40)]
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 40))
    rows = [tuple(None if (i + j) % 97 == 0 else float(v) for j, v in enumerate(r)) for i, r in enumerate(x)]
    r = T.little_mcar(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)), cols)
    assert r["dof"] > 100 and r["statistic"] > 0 and 0 <= r["p_value"] <= 1
