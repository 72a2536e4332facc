import numpy as np
from pyspark.sql import functions as F

from loanframe.operators import models as M
from loanframe.operators.sampling import smote
from loanframe.sources import loans as L
from tests.conftest import SF_SMALL


def _toy(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x @ np.array([1.5, -1.0, 0.5]) + 0.3 * rng.normal(size=n) > 0.8).astype(int)
    return spark.createDataFrame([(i, int(a), [float(v) for v in r]) for i, (a, r) in enumerate(zip(y, x))],
                                 "key bigint, label int, features array<double>"), x, y


def test_ridge_matches_numpy(spark):
    df, x, y = _toy(spark)
    m = M.fit_ridge(df, alpha=1.0)
    xc, yc = x - x.mean(0), (2 * y - 1) - (2 * y - 1).mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert np.allclose(m.w, w, atol=1e-9)


def test_logistic_newton_gradient_zero(spark):
    df, x, y = _toy(spark)
    m = M.fit_logistic(df, C=1.0)
    f = x @ m.w + m.b
    p = 1 / (1 + np.exp(-f))
    grad = x.T @ (p - y) + m.w  # C * X'(p - y) + w
    assert np.max(np.abs(grad)) < 1e-4 and abs(np.sum(p - y)) < 1e-4


def test_stratified_folds_balanced(spark):
    df, _, y = _toy(spark)
    f = M.stratified_folds(df, 5)
    sizes = {(r["label"], r["fold"]): r["count"] for r in f.groupBy("label", "fold").count().collect()}
    for c in (0, 1):
        v = [sizes[(c, k)] for k in range(5)]
        assert max(v) - min(v) <= 1 and sum(v) == int((y == c).sum())


def test_smote_balances_and_stays_on_segments(spark):
    df, x, y = _toy(spark)
    out = smote(df, k=5)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[0] == counts[1]
    syn = np.array([r["features"] for r in out.filter("synthetic").collect()])
    mino = x[y == 1] if (y == 1).sum() < (y == 0).sum() else x[y == 0]
    assert (syn >= mino.min(0) - 1e-9).all() and (syn <= mino.max(0) + 1e-9).all()


def test_split_disjoint_and_complete(spark):
    d = L.deduped(spark, SF_SMALL)
    tr, te = L.train_test(spark, SF_SMALL)
    n, a, b = d.count(), tr.count(), te.count()
    assert a + b == n and tr.join(te, "loan_id").count() == 0


def _log_loss_grad(x, y, w, b, wt):
    p = 1 / (1 + np.exp(-(x @ w + b)))
    return x.T @ (wt * (p - y)), np.sum(wt * (p - y))


def test_lockstep_models_reach_their_optimum(spark):
    """Every model of a lockstep fit satisfies the optimality conditions of its own training rows, L1 and L2."""
    from loanframe.functions.lockstep import Fit, fit_together
    df, x, y = _toy(spark, 400)
    outer = np.arange(400) % 3
    d = df.withColumn("outer", (F.col("key") % 3).cast("int")).withColumn("f2", (F.col("key") % 2).cast("int"))
    fits = fit_together(d, [Fit(1, None, None, 1.0), Fit(None, "f2", 0, 10.0, 1.0, 0.0, (1.0, 2.0)),
                            Fit(0, None, None, 10_000.0, 1.0, 0.0), Fit(2, None, None, 1.0, keep=np.array([True, False, True]))],
                        3, tol=1e-12)
    assert all(f.converged for f in fits)
    rows = [outer != 1, np.arange(400) % 2 != 0, outer != 0, outer != 2]
    for f, r in zip(fits, rows):
        w, b = f.beta[:3], f.beta[3]
        g, gb = _log_loss_grad(x[r], y[r], w, b, np.where(y[r] == 1, f.weights[1], f.weights[0]))
        g = f.C * g + f.l2 * w
        use = np.ones(3, bool) if f.keep is None else f.keep
        bad = np.where(w != 0, np.abs(g + f.l1 * np.sign(w)), np.maximum(np.abs(g) - f.l1, 0))
        assert bad[use].max() < 1e-2 + 1e-5 * f.C and f.C * abs(gb) < 1e-2 + 1e-5 * f.C, (bad, gb)
        assert (w[~use] == 0).all()


def test_grid_search_twice_on_different_data(spark):
    """The second search never sees the first one's folds or selection."""
    from loanframe.operators import tune as TU
    a, _, _ = _toy(spark, 240, 1)
    b, _, _ = _toy(spark, 240, 2)
    t1, best = TU.grid_l2(a, cv=3, selects=(2,), finals=(2, 3))
    TU.grid_l2(b, cv=3, selects=(2,), finals=(2, 3))
    t3, _ = TU.grid_l2(a, cv=3, selects=(2,), finals=(2, 3))
    assert sorted(map(tuple, t1.collect())) == sorted(map(tuple, t3.collect()))
    assert t1.where("best").count() == 1 and best.info["converged"] and t1.agg(F.min("mean_roc_auc")).first()[0] > 0.9


def test_smote_keys_of_many_copies(spark):
    rows = [(i, 1, [float(i), 0.0]) for i in range(3)] + [(2**62 + i, 0, [0.0, float(i)]) for i in range(4600)]
    out = smote(spark.createDataFrame(rows, "key bigint, label int, features array<double>"), k=2)
    assert out.where("synthetic").count() == 4597
    assert out.select("key", "copy").distinct().count() == out.count() == 9200


def test_lda_uses_the_pooled_covariance(spark):
    df, x, y = _toy(spark)
    m = M.fit_lda(df)
    s = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in (0, 1)) / (len(y) - 2)
    assert np.allclose(m.w, np.linalg.solve(s, x[y == 1].mean(0) - x[y == 0].mean(0)), atol=1e-8)


def test_folds_keep_rows_without_label(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i % 2) for i in range(100)], "key bigint, label int")
    f = M.stratified_folds(df, 5)
    assert f.count() == 100 and f.where("label IS NULL").count() == 10


def test_cv_path_converges_at_weak_penalties(spark):
    df, x, y = _toy(spark, 400)
    m = M.fit_logistic_cv(df, "l1", Cs=[1.0, 10_000.0], cv=3)
    assert m.info["converged"] and len(m.info["cv_scores"]) == 2 and min(m.info["cv_scores"]) > 0.9
    one = M.fit_logistic_cv(df, "l1", Cs=[10_000.0], cv=3)
    g, gb = _log_loss_grad(x, y, one.w, one.b, np.ones(len(y)))
    assert np.abs(1e4 * g + np.sign(one.w)).max() < 1e4 * 1e-3


def test_neighbours_are_exact_and_few_pairs_are_compared(spark, monkeypatch):
    """Clusters, equal points and ties; every neighbour as by comparing all."""
    from loanframe.functions import metric_index as MI
    rng = np.random.default_rng(4)
    centres = rng.uniform(-100, 100, size=(20, 6))
    x = np.concatenate([centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 6)),
                        np.round(rng.uniform(0, 3, size=(200, 6))), np.repeat(centres[:1], 300, axis=0)])
    keys = rng.permutation(len(x)) + 5
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(keys, x)], "key bigint, features array<double>")
    monkeypatch.setattr(MI, "BLOCK", 32)
    out, work = MI.nearest(df.repartition(5), "features", "key", 5)
    got = {}
    for r in out.collect():
        got.setdefault(r["key"], []).append((r["dist"], r["nbr"]))
    d = MI.squared_distances(x, x)
    for i in range(len(x)):
        others = sorted((float(d[i, j]), int(keys[j])) for j in np.argpartition(d[i], 330)[:331] if j != i)
        last = others[4][0]
        tied = sorted((float(v), int(keys[j])) for j, v in enumerate(d[i]) if j != i and v <= last)
        assert sorted(got[int(keys[i])]) == tied[:5], i
    w = work.first()
    assert w["points"] <= 1701 and w["compared"] < 0.25 * w["points"] ** 2


def test_neighbours_of_few_rows(spark):
    from loanframe.functions.metric_index import nearest
    df = spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, [5.0])], "key bigint, features array<double>")
    got = sorted(tuple(r) for r in nearest(df, "features", "key", 5)[0].collect())
    assert got == [(1, 2, 0.0), (1, 3, 25.0), (2, 1, 0.0), (2, 3, 25.0), (3, 1, 25.0), (3, 2, 25.0)]
    assert nearest(df.limit(0), "features", "key", 5)[0].count() == 0


def test_what_is_compared_grows_with_the_points(spark, monkeypatch):
    """Rows far from the crowd don't leave it to a few blocks: a point is compared with as many others in a larger table."""
    from loanframe.functions import metric_index as MI
    rng = np.random.default_rng(8)
    monkeypatch.setattr(MI, "BLOCK", 16)
    each = []
    for n in (1500, 6000):
        x = np.concatenate([rng.uniform(0, 1, size=(n, 2)), rng.uniform(1e3, 1e6, size=(70, 2))])
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key bigint, features array<double>")
        w = MI.nearest(df, "features", "key", 5)[1].first()
        each.append(w["compared"] / w["points"])
    assert each[1] < 1.25 * each[0] and each[1] < 150, each


def test_a_tree_of_equal_columns_ends(spark):
    from loanframe.functions import metric_index as MI
    x = np.array([[1.0, 0.0]] * 900 + [[1.0, 1.0]] * 100)
    tree = MI.Tree(x, 64)
    assert tree.leaves == 2 and set(tree.leaf_of(x).tolist()) == {0, 1}
    assert MI.Tree(x[:1], 64).leaf_of(x).tolist() == [0] * 1000
