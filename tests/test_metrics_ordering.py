import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanframe.functions.ordering import global_rank, running_sums
from loanframe.operators import metrics as K


def _scores(spark, y, s, model="m"):
    rows = [(model, i, int(a), float(b), None, int(b > 0.5)) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "model string, key bigint, label int, score double, prob double,"
                                       " prediction int")


def test_auc_and_ap_small_example(spark):
    sc = _scores(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    assert abs(K.roc_auc(sc).first()["roc_auc"] - 0.75) < 1e-12
    assert abs(K.average_precision(sc).first()["average_precision"] - 0.8333333333333333) < 1e-12


def test_auc_ties_and_monotone_invariance(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 500)
    s = np.round(rng.normal(size=500) + y, 1)
    a = K.roc_auc(_scores(spark, y, s)).first()["roc_auc"]
    b = K.roc_auc(_scores(spark, y, np.exp(s))).first()["roc_auc"]
    pos, neg = s[y == 1], s[y == 0]
    brute = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert abs(a - brute) < 1e-12 and abs(a - b) < 1e-12


def test_roc_curve_ends(spark):
    sc = _scores(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    pts = sorted((r["fpr"], r["tpr"]) for r in K.roc_curve(sc).collect())
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)


def test_global_rank_matches_row_number_without_single_partition(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v),) for v in rng.permutation(3000)], "x double").repartition(7)
    r = global_rank(df, "x")
    exp = df.withColumn("rn", F.row_number().over(W.orderBy("x")))
    bad = r.join(exp, "x").filter(F.col("rank") != F.col("rn")).count()
    assert bad == 0
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "_part" in plan


def test_running_sums_over_groups_ties_and_nulls(spark):
    """600 groups, one with a third of the rows, NULL groups and NULL order keys: as one window a group would do."""
    rows = [(g if g < 600 else None, k * 7 % 13 if k else None, k) for g in range(601) for k in range(5)]
    rows += [(5, 100 + k, k) for k in range(1500)]
    df = spark.createDataFrame(rows, "g long, o long, v long").groupBy("g", "o").agg(F.sum("v").alias("v"))
    w = W.partitionBy("g").orderBy("o")
    want = df.select("g", "o", "v", F.sum("v").over(w).alias("cum_v"), F.row_number().over(w).cast("long").alias("rank"),
                     F.lag("v").over(w).alias("pv_v"))
    for n in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got = running_sums(df, "g", "o", ["v"], lag=["v"])
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_quantiles_are_exact_at_any_size(spark):
    from loanframe.functions import quantile as Q
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=20_000), rng.choice([1.0, 2.0, 5.5], size=20_000, p=[0.4, 0.35, 0.25])
    df = spark.createDataFrame([(float(x), float(y) if i % 7 else None, None) for i, (x, y) in enumerate(zip(a, b))],
                               "a double, b double, c double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9999, 1.0]
    keep = np.array([i % 7 > 0 for i in range(20_000)])
    want = {"a": np.quantile(a, probs), "b": np.quantile(b[keep], probs)}
    for points, buffer, parts in ((10**6, 10**6, 1), (20, 100, 1), (20, 100, 13), (300, 50, 5)):
        got = Q.quantiles(df.repartition(parts), ["a", "b", "c"], probs, points, buffer)
        assert np.allclose(got["a"], want["a"], rtol=0, atol=1e-12) and np.allclose(got["b"], want["b"], rtol=0, atol=1e-12)
        assert got["c"] == [None] * len(probs)


def test_quantile_summaries_keep_their_bounds():
    from loanframe.functions.quantile import Summary
    rng = np.random.default_rng(9)
    whole, values = None, []
    for _ in range(40):
        v = np.round(rng.normal(size=rng.integers(1, 400)), rng.integers(0, 4))
        values.append(v)
        s = Summary.of(v).thinned(30)
        whole = s if whole is None else whole.merged(s).thinned(30)
    v = np.sort(np.concatenate(values))
    cum = np.cumsum(whole.w)
    true = np.searchsorted(v, whole.x, side="right")
    assert cum[-1] == len(v) and whole.err > 0 and (cum <= true).all() and (true <= cum + whole.err).all()
    for k in range(0, len(v), 7):
        lo, hi = whole.bracket(k)
        assert (lo is None or lo < v[k]) and v[k] <= hi


def test_quantiles_of_infinite_and_many_equal_values(spark):
    from loanframe.functions import quantile as Q
    v = [-np.inf] * 30 + [0.0] * 500 + [-0.0] * 100 + [float(i) for i in range(400)] + [np.inf] * 20
    df = spark.createDataFrame([(x,) for x in v], "a double").repartition(4)
    got = Q.quantiles(df, ["a"], [0.0, 0.02, 0.5, 0.9, 1.0], 16, 40)["a"]
    assert got == [-np.inf, -np.inf, 0.0, float(np.quantile(np.array(v[30:-20]), (0.9 * (len(v) - 1) - 30) / (len(v) - 51))), np.inf]


def test_roc_auc_of_huge_counts(spark):
    """Counts near 4e9 positives and negatives don't overflow."""
    base = spark.createDataFrame([("m", 0.2, 10, 4 * 10**9), ("m", 0.7, 4 * 10**9, 20)], "model string, score double, pos long, neg long")
    b = running_sums(base, "model", "score", ["pos", "neg"]).withColumns({"P": F.lit(4 * 10**9 + 10), "N": F.lit(4 * 10**9 + 20)})
    assert abs(K.roc_auc(None, b).first()["roc_auc"] - 1) < 1e-6


def test_confusion_and_counts(spark):
    sc = _scores(spark, [1, 1, 0, 0, 1], [0.9, 0.2, 0.7, 0.1, 0.8])
    cells = {(r["label"], r["prediction"]): r["count"] for r in K.confusion_matrix(sc).collect()}
    assert cells == {(1, 1): 2, (1, 0): 1, (0, 1): 1, (0, 0): 1}
    m = K.count_metrics(sc).first()
    assert abs(m["balanced_accuracy"] - (2 / 3 + 1 / 2) / 2) < 1e-12
