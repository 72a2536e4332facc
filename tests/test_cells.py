import numpy as np
from pyspark.sql import functions as F

from loanframe.functions import cells as C
from loanframe.functions import metric_index as MI
from loanframe.functions.gram import Interactions
from loanframe.functions import lockstep as LS
from loanframe.functions.lockstep import Fit, fit_together, held_out_hits
from loanframe.operators import metrics as K
from loanframe.operators import models as M
from loanframe.operators import online as O


def _rows(spark, n=600, seed=0):
    """Two numbers and three 0/1 columns, and the features they make."""
    rng = np.random.default_rng(seed)
    z = np.hstack([rng.normal(size=(n, 1)), (rng.random((n, 2)) < 0.4).astype(float), rng.normal(5, 2, size=(n, 1)),
                   (rng.random((n, 1)) < 0.2).astype(float)])
    made = Interactions(rng.normal(size=15), rng.uniform(0.5, 2.0, size=15))
    x = made(z)
    y = (x[:, 0] - x[:, 7] + rng.normal(size=n) > 0).astype(int)
    df = spark.createDataFrame([(i, int(a), [float(v) for v in r]) for i, (a, r) in enumerate(zip(y, z))],
                               "key bigint, label int, base array<double>").repartition(3)
    return df, x, y, made


def test_sums_by_cell_are_those_of_the_features(spark):
    df, x, y, made = _rows(spark)
    got = C.grams(df, "base", "label", made)
    for c in (0, 1):
        n, s, xx = got[c]
        assert n == (y == c).sum() and np.allclose(s, x[y == c].sum(0)) and np.allclose(xx, x[y == c].T @ x[y == c])


def test_fits_from_base_columns_reach_the_optimum(spark):
    """No table of features is needed: the optimality conditions hold on features made here."""
    df, x, y, made = _rows(spark)
    m = M.fit_logistic(df, features="base", expand=made)
    p = 1 / (1 + np.exp(-(x @ m.w + m.b)))
    assert np.abs(x.T @ (p - y) + m.w).max() < 1e-4 and abs((p - y).sum()) < 1e-4
    rows = C.stored(C.cell_rows(df.withColumn("outer", (F.col("key") % 3).cast("int")), "base", ["label", "outer"], made))
    fits = fit_together(rows, [Fit(0), Fit(1, l1=1.0, l2=0.0), Fit(0, keep=np.arange(15) < 4)], 15, tol=1e-12)
    outer = np.arange(len(y)) % 3
    hits = held_out_hits(rows, fits)
    for f, share in zip(fits, hits):
        r, w = outer != f.outer, f.beta[:-1]
        s = x @ w + f.beta[-1]
        g = x[r].T @ (1 / (1 + np.exp(-s[r])) - y[r]) + f.l2 * w
        bad = np.where(w != 0, np.abs(g + f.l1 * np.sign(w)), np.maximum(np.abs(g) - f.l1, 0))
        assert bad[f.keep if f.keep is not None else slice(None)].max() < 1e-2 and f.converged
        assert abs(share - np.mean((s[~r] > 0) == (y[~r] == 1))) < 1e-12


def test_stored_rows_are_blocks_of_one_cell(spark):
    """A cell is in few partitions and a stored row holds many rows, which come back as they were."""
    df, _, _, made = _rows(spark)
    rows = C.cell_rows(df.withColumn("extra", F.when(F.col("key") % 2 == 0, F.col("key"))), "base", ["label", "extra"], made)
    kept = C.stored(rows)
    assert rows.count == 600 and kept.df.count() < 200
    got = [(bits, *n[i].tolist(), *(b.column(c)[i].as_py() for c in (2, 3)))
           for bits, n, b in C.blocks(kept.table(["extra", "label"]).toArrow().to_batches(), ["extra", "label"]) for i in range(len(n))]
    want = [(bytes(r["bits"]), *r["n"], r["extra"], r["label"]) for r in rows.df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_aucs_of_many_models_move_runs_of_scores(spark, monkeypatch):
    """A stored row holds many scores of a model; the AUC is exact with ties, however the scores are cut into parts."""
    df, x, y, made = _rows(spark)
    rows = C.stored(C.cell_rows(df.withColumn("outer", (F.col("key") % 3).cast("int")), "base", ["label", "outer"], made))
    rng = np.random.default_rng(1)
    flags = np.where(np.isin(np.arange(16), (1, 2, 4)), 1.0, 0.0)          # few distinct scores
    fits = [Fit(o, beta=b) for o in (0, 1, 2) for b in (rng.normal(size=16), flags, np.zeros(16))] + [Fit(7, beta=flags)]
    outer, want = np.arange(len(y)) % 3, []
    for f in fits[:-1]:
        s, c = (x @ f.beta[:-1] + f.beta[-1])[outer == f.outer].round(9), y[outer == f.outer]
        a, b = s[c == 1][:, None], s[c == 0][None, :]
        want.append(((a > b).mean() + (a == b).mean() / 2))
    for held, run, most in ((1 << 22, 1 << 21, 100), (500, 40, 100_000)):
        monkeypatch.setattr(LS, "HELD", held)
        monkeypatch.setattr(LS, "RUN", run)
        monkeypatch.setattr(LS, "SAMPLE", 8)
        runs = LS.held_out_runs(rows, fits)
        assert runs.count() <= most                                        # 1,800 scores
        got = K.roc_auc_of_runs(runs)
        assert sorted(got) == list(range(9)) and np.allclose([got[m] for m in range(9)], want, atol=1e-12, rtol=0)
    assert runs.select("part").distinct().count() > 1


def test_blocks_of_a_shard_come_back_as_they_were(spark):
    df, _, _, _ = _rows(spark, 50)
    rows = O._sharded(df, "base", "label", "key", 2, 42)
    flags = O._flags(rows)
    assert flags.tolist() == [False, True, True, False, True]
    batch = rows.orderBy("shard", "place").select("shard", "y", "x").toArrow().combine_chunks().to_batches()
    packed = list(O._packed(batch, flags))
    assert sum(b.num_rows for b in packed) == 2                  # a row a shard, not a row a row
    got = np.concatenate([x for _, x, _ in O._unpacked(packed, flags)])
    assert np.array_equal(got, np.array([r["x"] for r in rows.orderBy("shard", "place").collect()]))


def test_shards_are_read_as_blocks_in_order(spark):
    """The shuffle that brings a shard to its task moves blocks, not rows, and their rows are in order."""
    df, _, _, _ = _rows(spark, 300)
    rows = O._sharded(df, "base", "label", "key", 2, 42)
    flags = O._flags(rows)
    order = O._in_order(rows, flags, 2)
    assert order.rdd.getNumPartitions() == 2 and order.count() < 100
    parts = order.withColumn("p", F.spark_partition_id()).orderBy("p").drop("p").toArrow().combine_chunks().to_batches()
    got = {}
    for shard, x, _ in O._unpacked(parts, flags):
        got[shard] = np.vstack([got[shard], x]) if shard in got else x
    for shard, x in got.items():
        want = rows.where(F.col("shard") == shard).orderBy("place", "key").collect()
        assert np.array_equal(x, np.array([r["x"] for r in want]))


def test_points_ask_blocks_a_few_rows_at_a_time(spark, monkeypatch):
    """However many blocks there are, a task holds ``CHUNK`` distances; the neighbours stay exact."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key bigint, features array<double>")
    monkeypatch.setattr(MI, "BLOCK", 16)
    want = sorted(map(tuple, MI.nearest(df.repartition(1), "features", "key", 4)[0].collect()))
    monkeypatch.setattr(MI, "CHUNK", 64)
    asked = MI.nearest(df.repartition(1), "features", "key", 4)
    assert sorted(map(tuple, asked[0].collect())) == want
    assert all(MI.rows_at_once(n) * n <= MI.CHUNK for n in (1, 7, 64))
