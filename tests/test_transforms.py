import numpy as np
from pyspark.sql import functions as F

from loanframe.operators.encode import MostFrequentImputer, OneHotEncoder, OrdinalEncoder
from loanframe.operators.impute import IterativeImputer
from loanframe.operators.numeric import KBinsDiscretizer, QuantileTransformer, YeoJohnson
from loanframe.operators.outliers import Winsorizer
from loanframe.sources import loans as L
from tests.conftest import SF_SMALL


def _train(spark):
    return L.train_test(spark, SF_SMALL)[0].cache()


def test_imputer_fills_and_keeps_observed(spark):
    tr = _train(spark)
    m = IterativeImputer(L.NUMERIC).fit(tr)
    out = m.transform(tr)
    nulls = out.select([F.count_if(F.col(c).isNull()) for c in L.NUMERIC]).first()
    assert all(v == 0 for v in nulls)
    j = tr.alias("a").join(out.alias("b"), "loan_id")
    bad = j.filter(F.col("a.loan_int_rate").isNotNull() & (F.col("a.loan_int_rate") != F.col("b.loan_int_rate")))
    assert bad.count() == 0
    # the transform is projections only: no aggregate, no python in the plan
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan


def test_winsorizer_within_fences_and_idempotent(spark):
    tr = _train(spark)
    m = Winsorizer(["person_income", "loan_amnt"]).fit(tr)
    once = m.transform(tr)
    f = m.fitted()["fences"]
    for c in ("person_income", "loan_amnt"):
        lo, hi = f[c]
        r = once.agg(F.min(c), F.max(c)).first()
        assert r[0] >= lo - 1e-9 and r[1] <= hi + 1e-9
    twice = m.transform(once)
    assert once.exceptAll(twice).count() == 0


def test_onehot_rows_sum_to_one_and_unknown_zero(spark):
    tr = _train(spark)
    m = OneHotEncoder(["loan_grade"]).fit(tr)
    out = m.transform(tr.select("loan_id", "loan_grade"))
    cols = [c for c in out.columns if c.startswith("loan_grade_")]
    s = out.select(sum((F.col(c) for c in cols), F.lit(0.0)).alias("s")).distinct().collect()
    assert [r["s"] for r in s] == [1.0]
    unk = spark.createDataFrame([(1, "Z")], "loan_id bigint, loan_grade string")
    r = m.transform(unk).first()
    assert all(r[c] == 0.0 for c in cols)


def test_ordinal_and_mode(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",), ("a",)], "x string")
    assert MostFrequentImputer(["x"]).fit(df).fitted()["fill"]["x"] == "a"  # tie: lowest
    codes = [r["x"] for r in OrdinalEncoder(["x"]).fit(df).transform(df).collect()]
    assert codes == [1.0, 0.0, 1.0, None, 2.0, 0.0]


def test_kbins_and_quantile_and_yeo_johnson(spark):
    tr = _train(spark)
    kb = KBinsDiscretizer(["person_age"], n_bins=3).fit(tr).transform(tr)
    assert {r[0] for r in kb.select("person_age").distinct().collect()} <= {0.0, 1.0, 2.0}
    qt = QuantileTransformer(["loan_amnt"]).fit(tr).transform(tr)
    r = qt.agg(F.avg("loan_amnt"), F.stddev("loan_amnt")).first()
    assert abs(r[0]) < 0.1 and 0.8 < r[1] < 1.25
    yj = YeoJohnson(["loan_amnt"]).fit(tr)
    assert -5 <= yj.fitted()["lambdas"]["loan_amnt"] <= 5


def test_yeo_johnson_follows_its_maximum_beyond_the_first_bracket(spark):
    from loanframe.operators import numeric as N
    rng = np.random.default_rng(4)
    a, b = np.exp(rng.normal(size=2000)), 3.0 + 0.8 * rng.normal(size=2000)
    b = (1 + 9.0 * np.abs(b)) ** (1 / 9.0) - 1                     # its best lambda lies above 5
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    lam = N.YeoJohnson(["a", "b"]).fit(df).fitted()["lambdas"]

    def loglik(x, v):
        t = ((x + 1) ** v - 1) / v
        return -len(x) / 2 * np.log(t.var()) + (v - 1) * np.log1p(x).sum()
    for name, x in (("a", a), ("b", b)):
        here = loglik(x, lam[name])
        assert here >= max(loglik(x, lam[name] + d) for d in (-1e-3, 1e-3, -0.5, 0.5)) - 1e-9
    assert lam["b"] > 5.5


def test_most_frequent_of_many_levels_and_nulls(spark):
    rows = [(f"level{i}", None if i % 2 else "x") for i in range(20_000)] + [("level7", "y"), (None, "y")]
    df = spark.createDataFrame(rows, "a string, b string")
    out = MostFrequentImputer(["a", "b"]).fit(df).transform(df)
    assert out.where("a = 'level7'").count() == 3 and out.where("b = 'x'").count() == 20_000


def test_columns_of_many_levels_encode(spark):
    """200,000 levels: codes by join, dummies as one sparse vector, as by the lists of a column of few."""
    from loanframe.operators import encode as E
    n = 200_000
    df = spark.range(0, 3 * n, 1, 8).selectExpr(
        "id", f"CASE WHEN id % 1000 = 7 THEN NULL WHEN id < {n} THEN 'hot' ELSE concat('v', lpad(id % {n}, 6, '0')) END AS c",
        "CASE WHEN id % 3 = 0 THEN 'x' ELSE 'y' END AS few")
    assert E.level_sizes(df, ["c", "few"])["few"] == 2
    out = E.OrdinalEncoder(["c", "few"]).fit(df).transform(df)
    r = {x["id"]: x for x in out.where("id IN (1, 7, 200001, 400001, 599999)").collect()}
    levels = n - n // 1000 + 1                                  # every 1000th is NULL wherever it occurs
    assert r[7]["c"] is None and r[1]["c"] == 0.0 and r[200001]["c"] == r[400001]["c"] == 2.0 and r[599999]["c"] == levels - 1
    assert r[1]["few"] == 1.0 and out.count() == 3 * n
    m = E.SparseOneHotEncoder(["c", "few"], drop="if_binary").fit(df)
    v = {x["id"]: x["onehot"] for x in m.transform(df).where("id IN (1, 7, 200001, 599999)").collect()}
    assert {x.size for x in v.values()} == {levels + 1}
    assert v[1].indices.tolist() == [0, levels] and v[7].indices.tolist() == [levels] and v[200001].indices.tolist() == [2]
    assert v[599999].indices.tolist() == [levels - 1, levels]
    unseen = spark.createDataFrame([(1, "never", "y"), (2, None, None)], "id long, c string, few string")
    assert [x["onehot"].indices.tolist() for x in m.transform(unseen).orderBy("id").collect()] == [[levels], []]
    few = E.OrdinalEncoder(["few"], max_levels=1).fit(df).transform(df).where("id < 2").orderBy("id").collect()
    assert [x["few"] for x in few] == [0.0, 1.0]
