import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanframe.functions import gram as G
from loanframe.operators import models as M
from loanframe.operators import online as O
from loanframe.operators.numeric import PolynomialFeatures, products, yj_loglik

COLUMNS = "key bigint, label int, features array<double>"


def _toy(spark, n=700, seed=0, p=3, noise=0.6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = (x[:, 0] - x[:, 1] + noise * rng.normal(size=n) > 0.4).astype(int)
    return spark.createDataFrame([(i, int(a), [float(v) for v in r]) for i, (a, r) in enumerate(zip(y, x))], COLUMNS), x, y


def _one_by_one(kind, x, y, epochs, alpha=1e-4, C=1.0):
    """The sequential learner, a row at a time: weights and mean loss of each epoch."""
    w, b, t, losses = np.zeros(x.shape[1]), 0.0, 1, []
    t0 = 1.0 / (math.sqrt(1.0 / math.sqrt(alpha)) * alpha)
    for _ in range(epochs):
        loss = 0.0
        for xi, yi in zip(x, y):
            m = yi * (xi @ w + b)
            eta = 1.0 / (alpha * (t0 + t - 1))
            if kind == "log":
                loss += np.logaddexp(0, -m)
                step, shrink = eta * yi / (1.0 + math.exp(m)), 1 - eta * alpha
            elif kind == "hinge":
                loss += max(0.0, 1 - m)
                step, shrink = eta * yi * (m < 1), 1 - eta * alpha
            elif kind == "perceptron":
                loss += max(0.0, -m)
                step, shrink = yi * (m <= 0), 1.0
            else:
                loss += max(0.0, 1 - m)
                step, shrink = yi * min(C, max(0.0, 1 - m) / (xi @ xi)), 1.0
            w = w * shrink + step * xi
            b += step
            t += 1
        losses.append(loss / len(y))
    return w, b, losses


@pytest.mark.parametrize("kind", ["log", "hinge", "perceptron", "pa"])
def test_one_shard_is_the_sequential_learner(spark, kind):
    df, x, y = _toy(spark)
    order = [r["key"] for r in O._sharded(df, "features", "label", "key", 1, 42).orderBy("shard", "place").collect()]
    m = O.fit_online(df, kind, shards=1, max_iter=4, tol=-math.inf)
    w, b, losses = _one_by_one(kind, x[order], 2.0 * y[order] - 1.0, 4)
    assert np.allclose(m.w, w, rtol=1e-7, atol=1e-9) and abs(m.b - b) < 1e-7
    assert np.allclose(m.info["losses"], losses, rtol=1e-9, atol=1e-12) and m.info["rounds"] == 4 and not m.info["converged"]


@pytest.mark.parametrize("kind", ["log", "hinge", "perceptron", "pa"])
def test_weights_do_not_depend_on_the_cluster(spark, kind):
    df, x, y = _toy(spark, 2000, 5)
    a, b = (O.fit_online(df.repartition(n), kind, max_iter=30) for n in (2, 7))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    c = O.fit_online(df.repartition(3), kind, max_iter=30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert np.array_equal(a.w, b.w) and a.b == b.b and np.array_equal(a.w, c.w) and a.info == b.info == c.info
    assert np.mean((x @ a.w + a.b > 0) == (y == 1)) > 0.8


def test_epochs_stop_by_tolerance(spark):
    df, _, _ = _toy(spark, 400, 2, noise=0.0)
    m = O.fit_online(df, "log")
    losses, best, waited = m.info["losses"], math.inf, 0
    for v in losses:
        waited = waited + 1 if v > best - 1e-3 else 0
        best = min(best, v)
    assert m.info["converged"] and waited == 5 and m.info["rounds"] == len(losses) < 1000
    empty = O.fit_online(df.where("key < 0"), "pa")
    assert not empty.w.any() and empty.b == 0


def test_ridge_cv_is_leave_one_out(spark):
    """The errors of all alphas are those of n refits."""
    df, x, y = _toy(spark, 200, 3, p=4)
    alphas = [float(v) for v in np.logspace(-6, 6, 13)]
    m = M.fit_ridge_cv(df)
    s, want = 2.0 * y - 1.0, []
    for a in alphas:
        sse = 0.0
        for i in range(len(s)):
            keep = np.arange(len(s)) != i
            mx, my = x[keep].mean(0), s[keep].mean()
            w = np.linalg.solve((x[keep] - mx).T @ (x[keep] - mx) + a * np.eye(4), (x[keep] - mx).T @ (s[keep] - my))
            sse += (s[i] - my - (x[i] - mx) @ w) ** 2
        want.append(sse / len(s))
    assert np.allclose(m.info["cv_mse"], want, rtol=1e-9)
    assert m.info["best_alpha"] == alphas[int(np.argmin(want))]
    mx = x.mean(0)
    w = np.linalg.solve((x - mx).T @ (x - mx) + m.info["best_alpha"] * np.eye(4), (x - mx).T @ (s - s.mean()))
    assert np.allclose(m.w, w, atol=1e-9)


def test_interactions_are_made_where_they_are_used(spark):
    """Gram matrix, fits and scores from base columns equal those from the features written out."""
    df, x, y = _toy(spark, 300, 4, p=5)
    rng = np.random.default_rng(1)
    made = G.Interactions(rng.normal(size=15), rng.uniform(0.5, 2.0, size=15))
    wide = PolynomialFeatures([f"c{i}" for i in range(5)], interaction_only=True, output_col="features").transform(
        df.select("key", "label", *[F.col("features")[i].alias(f"c{i}") for i in range(5)]))
    mean, scale = (F.array(*[F.lit(float(v)) for v in a]) for a in (made.mean, made.scale))
    wide = wide.withColumn("features", F.transform("features", lambda v, i: (v - mean[i]) / scale[i]))
    a, b = G.gram_by_group(wide, "features", "label")[None], G.gram_by_group(df, "features", "label", expand=made, p=15)[None]
    assert all(np.allclose(a[k], b[k], rtol=1e-12, atol=1e-9) for k in a)
    for one, two in ((M.fit_ridge(wide), M.fit_ridge(df, expand=made)), (M.fit_lda(wide), M.fit_lda(df, expand=made)),
                     (M.fit_ridge_cv(wide), M.fit_ridge_cv(df, expand=made, p=15))):
        assert np.allclose(one.w, two.w, atol=1e-8) and one.info.get("best_alpha") == two.info.get("best_alpha")
        s1 = {r["key"]: r["score"] for r in one.score(wide).collect()}
        s2 = {r["key"]: r["score"] for r in two.score(df, expand=made).collect()}
        assert max(abs(s1[k] - s2[k]) for k in s1) < 1e-9
    a, b = O.fit_online(wide, "hinge", max_iter=5), O.fit_online(df, "hinge", max_iter=5, expand=made)
    assert np.allclose(a.w, b.w, atol=1e-8)
    got = df.select(products(F.col("features"), 5, False).alias("f")).first()["f"]
    z = x[0]
    assert np.allclose(got, [*z, *(z[i] * z[j] for i in range(5) for j in range(i, 5))])
    assert wide.select("features").where(F.size("features") != 15).count() == 0


def test_sums_do_not_depend_on_partitions(spark):
    df, x, _ = _toy(spark, 500, 6)
    for n in (1, 3, 50):
        g = G.gram_by_group(df.repartition(n), "features")[None]
        assert g["n"] == 500 and np.allclose(g["xtx"], x.T @ x) and np.allclose(g["sx"], x.sum(0))
    assert G.partition_sums(df.where("key < 0"), lambda b: np.ones(3), 3).tolist() == [0, 0, 0]


def test_yeo_johnson_candidates_in_one_pass(spark):
    rng = np.random.default_rng(8)
    a, b = rng.lognormal(size=400), rng.normal(size=400) * 300
    rows = [(float(u), float(v) if i % 5 else None) for i, (u, v) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    got = yj_loglik(df, {"a": [-1.0, 0.0, 0.5, 2.0], "b": [0.0, 1.0, 2.0, 400.0]})

    def want(x, lam):
        up = np.log1p(x[x >= 0]) if lam == 0 else ((x[x >= 0] + 1) ** lam - 1) / lam
        down = -np.log1p(-x[x < 0]) if lam == 2 else -((1 - x[x < 0]) ** (2 - lam) - 1) / (2 - lam)
        psi = np.concatenate([up, down])
        return -len(x) / 2 * np.log(psi.var()) + (lam - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))
    assert [lam for lam, _ in got["b"]] == [0.0, 1.0, 2.0]              # the last one overflows
    for c, x in (("a", a), ("b", b[np.arange(400) % 5 > 0])):
        assert all(abs(v - want(x, lam)) < 1e-8 * abs(v) for lam, v in got[c])


def test_every_shard_is_a_partition_of_its_own(spark):
    """By a hash of the shard's number three of the eight were in one task, and two tasks had none."""
    df, _, _ = _toy(spark, 600)
    rows = O._sharded(df, "features", "label", "key", 8, 42)
    got = O._in_order(rows, O._flags(rows), 8).select("shard", F.spark_partition_id().alias("part")).distinct().collect()
    assert len(got) == len({r["shard"] for r in got}) == len({r["part"] for r in got}) == 8


@pytest.mark.parametrize("kind", ["hinge", "perceptron"])
def test_a_block_is_answered_together(kind, monkeypatch):
    """Late in a fit nearly all blocks are settled by rounds over the whole block, with the updates of going row by row."""
    rng = np.random.default_rng(3)
    x, alone = rng.normal(size=(4096, 6)), []
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=4096) > 0, 1.0, -1.0)
    one = O._in_turn

    def counted(m, effect, every, each, together):
        def seen(i, v):
            alone.append(i)
            return each(i, v)
        return one(m, effect, every, seen, together)

    def fitted(n):
        learner = O.Learner(kind, np.zeros(6), 0.0, 100_000, 1e-4, 1.0)
        for lo in range(0, len(y), n):
            learner.block(x[lo:lo + n], y[lo:lo + n])
        return learner
    row_by_row = fitted(1)
    monkeypatch.setattr(O, "_in_turn", counted)
    blocks = fitted(O.BLOCK)
    assert len(alone) < 0.1 * len(y)
    assert np.allclose(blocks.weights(), row_by_row.weights(), rtol=1e-9, atol=1e-12)
    assert abs(blocks.b - row_by_row.b) < 1e-9 and abs(blocks.loss - row_by_row.loss) < 1e-6


def test_a_panel_deals_its_rows_once(spark):
    from loanframe.operators import tune as TU
    df, _, _ = _toy(spark, 200)
    made = []
    shards = TU.Once(lambda d: made.append(d) or O.Dealt(d))
    panel = TU.default_panel(shards=shards)
    for name, kind in (("Perceptron", "perceptron"), ("PassiveAggressiveClassifier", "pa")):
        a, b = panel[name](df), O.fit_online(df, kind)
        assert np.array_equal(a.w, b.w) and a.b == b.b and a.info == b.info
    assert len(made) == 1
    shards.made.close()
