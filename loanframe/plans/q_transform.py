"""Registered queries: fitted transforms, encoders, pipelines, sources/sinks.

Transforms are fitted on the train rows and applied to the test rows (the
cited fit/transform split), so each oracle recomputes the train constants
in SQL and applies them to ``test``.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from loanframe.functions.dist import norm_ppf, norm_ppf_sql
from loanframe.operators import encode as E
from loanframe.operators import numeric as N
from loanframe.operators.impute import IterativeImputer
from loanframe.operators.outliers import Winsorizer
from loanframe.plans import pipelines as PL
from loanframe.plans.catalog import register
from loanframe.sources import io
from loanframe.sources import loans as L
from loanframe.session import ensure_checkpoint_dir

NUM = L.NUMERIC
CAT = L.CATEGORICAL
# The levels of the fixture's category columns (loan view definition).
LEVELS = {
    "person_home_ownership": ["MORTGAGE", "OTHER", "OWN", "RENT"],
    "loan_intent": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "loan_grade": ["A", "B", "C", "D", "E", "F", "G"],
    "cb_person_default_on_file": ["false", "true"],
}


def _split(spark, sf_dir):
    return L.train_test(spark, sf_dir)


def _r(cols, d=6):
    return {c: d for c in cols}


def _q(name: str) -> str:
    return '"' + name + '"'


# ------------------------------------------------------------------- O6

@register("o6_winsorize", sql=L.with_loans(
    ", f AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.25) - (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) * 1.5 AS lo_{c},"
        f" quantile_cont({c}, 0.75) + (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) * 1.5 AS hi_{c}"
        for c in NUM) + " FROM train)\nSELECT loan_id, " + ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, lo_{c}), hi_{c}) END AS {c}" for c in NUM)
    + " FROM test, f"), rounding=_r(NUM))
def o6_winsorize(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    m = Winsorizer(NUM).fit(train)
    return m.transform(test).select("loan_id", *NUM)


# ------------------------------------------------------------------- I1

_CATS = CAT + ["cb_person_default_on_file"]


@register("i1_most_frequent", sql=L.with_loans(
    ", lv AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS level, count(*) AS count FROM train"
        f" WHERE {c} IS NOT NULL GROUP BY {c}" for c in _CATS)
    + ") SELECT \"column\", level AS mode, count FROM (SELECT *, row_number() OVER"
      " (PARTITION BY \"column\" ORDER BY count DESC, level) AS r FROM lv) WHERE r = 1"))
def i1_most_frequent(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    return E.most_frequent(train, _CATS)


@register("i1_impute_apply", sql=L.with_loans(
    "SELECT loan_id, " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _CATS) + " FROM test"))
def i1_impute_apply(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    m = E.MostFrequentImputer(_CATS).fit(train)
    return m.transform(test).select("loan_id", *[F.col(c).cast("string").alias(c) for c in _CATS])


# ------------------------------------------------------------------- I2

@register("i2_start_means", sql=L.with_loans(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CAST({c} AS DOUBLE)) AS mean FROM train" for c in NUM)),
    rounding={"mean": 6})
def i2_start_means(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    m = IterativeImputer(NUM, max_iter=0).fit(train)
    means = m.fitted()["means"]
    return spark.createDataFrame([(c, float(v)) for c, v in zip(NUM, means)], "column string, mean double")


@register("i2_iterative_impute")
def i2_iterative_impute(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    m = IterativeImputer(NUM, max_iter=10).fit(train)
    return m.transform(test).select("loan_id", *NUM)


# ------------------------------------------------------------------- I3

@register("i3_yeo_johnson_lambdas")
def i3_yeo_johnson_lambdas(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    lam = N.YeoJohnson(NUM).fit(train).fitted()["lambdas"]
    return spark.createDataFrame([(c, float(lam[c])) for c in NUM], "column string, lambda double")


def _yj_sql(x: str, lam: float) -> str:
    if lam == 0.0:
        pos = f"ln(1 + {x})"
    else:
        pos = f"(power({x} + 1.0, {lam}) - 1.0) / {lam}"
    if lam == 2.0:
        neg = f"-ln(1 - {x})"
    else:
        neg = f"-(power(1.0 - {x}, {2.0 - lam}) - 1.0) / {2.0 - lam}"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 0 THEN {pos} ELSE {neg} END"


@register("i3_yeo_johnson_apply", sql=L.with_loans(
    "SELECT loan_id, " + _yj_sql("person_income", 0.0) + " AS yj_income, "
    + _yj_sql("loan_amnt", 0.5) + " AS yj_amount, "
    + _yj_sql("(loan_int_rate - 12.0)", 2.0) + " AS yj_rate, "
    + _yj_sql("(loan_int_rate - 12.0)", -0.7) + " AS yj_rate_neg FROM test"),
    rounding={"yj_income": 9, "yj_amount": 6, "yj_rate": 9, "yj_rate_neg": 9})
def i3_yeo_johnson_apply(spark, sf_dir):
    """The transform for given lambdas, on all four branches (SQL* oracle)."""
    _, test = _split(spark, sf_dir)
    rate = F.col("loan_int_rate") - F.lit(12.0)
    return test.select("loan_id",
                       N.yeo_johnson(F.col("person_income"), 0.0).alias("yj_income"),
                       N.yeo_johnson(F.col("loan_amnt"), 0.5).alias("yj_amount"),
                       N.yeo_johnson(rate, 2.0).alias("yj_rate"),
                       N.yeo_johnson(rate, -0.7).alias("yj_rate_neg"))


@register("i3_yeo_johnson")
def i3_yeo_johnson(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return N.YeoJohnson(NUM).fit(train).transform(test).select("loan_id", *NUM)


# ------------------------------------------------------------------- I4

def _quantile_normal_sql(cols: list[str]) -> str:
    """Interpolation between 100 knots from the left and from the right, their mean, and the inverse normal of it."""
    refs = "[" + ", ".join(f"{i} / 99.0::DOUBLE" for i in range(100)) + "]"
    clip = repr(float(norm_ppf(np.array([N.BOUNDS - np.spacing(1)]))[0]))
    knots = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {refs}) AS k{i}" for i, c in enumerate(cols))
    places, values, normals = [], [], []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        places.append(f"{x} AS x{i}, k{i}, len(list_filter(k{i}, lambda k: k <= {x})) AS a{i}, 100 - len(list_filter(k{i}, lambda k: k >= {x})) + 1 AS b{i}")
        fwd = f"CASE WHEN a{i} = 0 THEN 0.0 WHEN a{i} = 100 THEN 1.0 ELSE (a{i} - 1) / 99.0 + (x{i} - k{i}[a{i}]) / (k{i}[a{i} + 1] - k{i}[a{i}]) / 99.0 END"
        bwd = f"CASE WHEN b{i} = 101 THEN 1.0 WHEN b{i} = 1 THEN 0.0 ELSE (b{i} - 1) / 99.0 + (x{i} - k{i}[b{i}]) / (k{i}[b{i}] - k{i}[b{i} - 1]) / 99.0 END"
        values.append(f"CASE WHEN x{i} IS NULL THEN NULL WHEN x{i} + {N.BOUNDS} > k{i}[100] THEN 1.0 WHEN x{i} - {N.BOUNDS} < k{i}[1] THEN 0.0"
                      f" ELSE 0.5 * ({fwd} + {bwd}) END AS u{i}")
        inside = f"CASE WHEN u{i} > 0 AND u{i} < 1 THEN u{i} ELSE 0.5 END"
        normals.append(f"CASE WHEN u{i} IS NULL THEN NULL WHEN u{i} <= 0 THEN {clip} WHEN u{i} >= 1 THEN -({clip})"
                       f" ELSE least(greatest({norm_ppf_sql(f'({inside})')}, {clip}), -({clip})) END AS {c}")
    return L.with_loans(f", k AS (SELECT {knots} FROM train), p AS (SELECT loan_id, {', '.join(places)} FROM test, k),"
                        f" u AS (SELECT loan_id, {', '.join(values)} FROM p) SELECT loan_id, {', '.join(normals)} FROM u")


@register("i4_quantile_normal", sql=_quantile_normal_sql(NUM), rounding={c: 6 for c in NUM})
def i4_quantile_normal(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    m = N.QuantileTransformer(NUM, n_quantiles=100).fit(train)
    return m.transform(test).select("loan_id", *NUM)


# ------------------------------------------------------------------- I5-I8

@register("i5_minmax", sql=L.with_loans(
    ", s AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in NUM)
    + " FROM train) SELECT loan_id, " + ", ".join(
        f"({c} - lo_{c}) / CASE WHEN hi_{c} - lo_{c} = 0 THEN 1.0 ELSE hi_{c} - lo_{c} END AS {c}" for c in NUM)
    + " FROM test, s"), rounding=_r(NUM, 9))
def i5_minmax(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return N.MinMaxScaler(NUM).fit(train).transform(test).select("loan_id", *NUM)


@register("i6_standard", sql=L.with_loans(
    ", s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUM)
    + " FROM train) SELECT loan_id, " + ", ".join(
        f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END AS {c}" for c in NUM)
    + " FROM test, s"), rounding=_r(NUM, 6))
def i6_standard(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return N.StandardScaler(NUM).fit(train).transform(test).select("loan_id", *NUM)


_THIRD, _TWO_THIRDS = repr(1 / 3), repr(2 / 3)


def _kbins_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL ELSE CAST({c} >= e1_{c} AS DOUBLE)"
            f" + CAST({c} >= e2_{c} AS DOUBLE) END")


_EDGES_SQL = (", e AS (SELECT " + ", ".join(
    f"quantile_cont({c}, {_THIRD}) AS e1_{c}, quantile_cont({c}, {_TWO_THIRDS}) AS e2_{c}" for c in NUM)
    + " FROM train)")


@register("i7_kbins", sql=L.with_loans(
    _EDGES_SQL + " SELECT loan_id, " + ", ".join(f"{_kbins_sql(c)} AS {c}" for c in NUM) + " FROM test, e"))
def i7_kbins(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return N.KBinsDiscretizer(NUM, n_bins=3).fit(train).transform(test).select("loan_id", *NUM)


@register("i8_binarize", sql=L.with_loans(
    "SELECT loan_id, " + ", ".join(f"CAST({c} > 1.1 AS DOUBLE) AS {c}" for c in NUM) + " FROM test"))
def i8_binarize(spark, sf_dir):
    _, test = _split(spark, sf_dir)
    return N.Binarizer(NUM, threshold=1.1).transform(test).select("loan_id", *NUM)


# ------------------------------------------------------------------- I9 / I10

_POLY = L.NUMERIC


def _poly_sql(interaction_only: bool) -> str:
    terms = N.polynomial_terms(_POLY, interaction_only)
    exprs = [" * ".join(f"CAST({_POLY[i]} AS DOUBLE)" for i in idx) + f" AS {_q(n)}" for n, idx in terms]
    return L.with_loans("SELECT loan_id, " + ", ".join(exprs) + " FROM test")


@register("i9_polynomial", sql=_poly_sql(False))
def i9_polynomial(spark, sf_dir):
    _, test = _split(spark, sf_dir)
    return N.PolynomialFeatures(_POLY).transform(test.select("loan_id", *_POLY))


@register("i10_interactions", sql=_poly_sql(True))
def i10_interactions(spark, sf_dir):
    _, test = _split(spark, sf_dir)
    return N.PolynomialFeatures(_POLY, interaction_only=True).transform(test.select("loan_id", *_POLY))


# ------------------------------------------------------------------- E1-E10

def _rank_sql(c: str, before: str = "<") -> str:
    return (f"CAST((SELECT count(DISTINCT t.{c}) FROM train t WHERE t.{c} {before} x.{c}) AS DOUBLE)")


@register("e1_label_encode", sql=L.with_loans(
    f"SELECT loan_id, {_rank_sql('person_home_ownership')} AS person_home_ownership FROM test x"))
def e1_label_encode(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    m = E.OrdinalEncoder(["person_home_ownership"]).fit(train)
    return m.transform(test).select("loan_id", "person_home_ownership")


def _dummies_sql(cols: list[str], drop: str | None, one: str, zero: str, src: str) -> str:
    parts = []
    for c in cols:
        lv = LEVELS[c]
        if drop == "first" or (drop == "if_binary" and len(lv) == 2):
            lv = lv[1:]
        for v in lv:
            parts.append(f"CASE WHEN CAST({c} AS VARCHAR) = '{v}' THEN {one} ELSE {zero} END AS {_q(c + '_' + v)}")
    return ", ".join(parts)


@register("e2_get_dummies", sql=L.with_loans(
    "SELECT * EXCLUDE (" + ", ".join(CAT) + "), " + _dummies_sql(CAT, "first", "1", "0", "dedup")
    + " FROM dedup"))
def e2_get_dummies(spark, sf_dir):
    return E.get_dummies(L.deduped(spark, sf_dir), CAT, drop_first=True)


@register("e3_onehot_if_binary", sql=L.with_loans(
    "SELECT loan_id, " + _dummies_sql(_CATS, "if_binary", "1.0", "0.0", "test") + " FROM test"))
def e3_onehot_if_binary(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    m = E.OneHotEncoder(_CATS, drop="if_binary").fit(PL.prepare(train))
    return m.transform(PL.prepare(test).select("loan_id", *_CATS))


@register("e4_onehot", sql=L.with_loans(
    "SELECT loan_id, " + _dummies_sql(_CATS, None, "1.0", "0.0", "test") + " FROM test"))
def e4_onehot(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    m = E.OneHotEncoder(_CATS).fit(PL.prepare(train))
    return m.transform(PL.prepare(test).select("loan_id", *_CATS))


_BIN_COLS = L.NUMERIC


@register("e5_onehot_bins", sql=L.with_loans(
    _EDGES_SQL + ", b AS (SELECT loan_id, " + ", ".join(f"{_kbins_sql(c)} AS {c}" for c in _BIN_COLS)
    + " FROM test, e) SELECT loan_id, " + ", ".join(
        f"CASE WHEN {c} = {k}.0 THEN 1.0 ELSE 0.0 END AS {_q(f'{c}_{k}.0')}" for c in _BIN_COLS for k in (1, 2))
    + " FROM b"))
def e5_onehot_bins(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    kb = N.KBinsDiscretizer(_BIN_COLS, n_bins=3).fit(train)
    tr = kb.transform(train.select("loan_id", *_BIN_COLS))
    oh = E.OneHotEncoder(_BIN_COLS, drop="first").fit(tr)
    return oh.transform(kb.transform(test.select("loan_id", *_BIN_COLS)))


@register("e6_ordinal", sql=L.with_loans(
    f"SELECT loan_id, {_rank_sql('loan_intent', '>')} AS loan_intent FROM test x"))
def e6_ordinal(spark, sf_dir):
    """Priorities coded from the lowest up: an order of its own, not that of the names."""
    train, test = _split(spark, sf_dir)
    levels = {c: v[::-1] for c, v in E.sorted_levels(train, ["loan_intent"]).items()}
    m = E.OrdinalEncoder(["loan_intent"], categories=levels).fit(train)
    return m.transform(test).select("loan_id", "loan_intent")


@register("e7_group_count", sql=L.with_loans(
    "SELECT loan_id, person_home_ownership, CASE WHEN person_home_ownership IS NULL THEN NULL ELSE"
    " count(loan_grade) OVER (PARTITION BY person_home_ownership) END AS loan_grade_count FROM train"))
def e7_group_count(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    return E.group_count(train, "person_home_ownership", "loan_grade", "loan_grade_count").select(
        "loan_id", "person_home_ownership", "loan_grade_count")


@register("e8_frequency", sql=L.with_loans(
    "SELECT loan_id, coalesce(CAST(loan_int_rate AS VARCHAR), 'NONE') AS level,"
    " count(*) OVER (PARTITION BY coalesce(CAST(loan_int_rate AS VARCHAR), 'NONE')) AS frequency FROM train"))
def e8_frequency(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    d = E.frequency_feature(train, "loan_int_rate", name="frequency")
    return d.select("loan_id", F.col("_loan_int_rate_level").alias("level"), "frequency")


@register("e9_levels", sql=L.with_loans(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS BIGINT) AS level_index,"
    f" {c} AS level FROM (SELECT DISTINCT {c} FROM train WHERE {c} IS NOT NULL)" for c in CAT)))
def e9_levels(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    return E.levels_table(train, CAT)


_NAMES_SQL = " UNION ALL ".join(
    [f"SELECT {i} AS block, '' AS level, '{c}' AS name" for i, c in enumerate(NUM)]
    + [f"SELECT {len(NUM) + i}, level, '{c}_' || level FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS level FROM train WHERE {c} IS NOT NULL)"
       " QUALIFY NOT (count(*) OVER () = 2 AND row_number() OVER (ORDER BY level) = 1)" for i, c in enumerate(_CATS)])


@register("e10_feature_names", sql=L.with_loans(
    f"SELECT CAST(row_number() OVER (ORDER BY block, level) - 1 AS BIGINT) AS position, name FROM ({_NAMES_SQL}) AS f"))
def e10_feature_names(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    m = E.OneHotEncoder(_CATS, drop="if_binary").fit(PL.prepare(train))
    names = NUM + m.output_cols()
    return E.feature_names_table(spark, names)


# ------------------------------------------------------------------- L1-L9

def _feature_query(name):
    def run(spark, sf_dir):
        train, test = _split(spark, sf_dir)
        model = PL.fit_pipeline(name, train)
        halves = [PL.transform(model, d).withColumn("split", F.lit(n)) for n, d in (("train", train), ("test", test))]
        return halves[0].unionByName(halves[1])
    return run


for _i, _name in enumerate(["linear", "tree", "distance", "probability", "neural"], start=1):
    register(f"l{_i}_{_name}_features")(_feature_query(_name))


@register("l6_column_transformer")
def l6_column_transformer(spark, sf_dir):
    """Numeric and category branches glued in declared order (names + values), train and test rows."""
    train, test = _split(spark, sf_dir)
    model = PL.fit_pipeline("tree", train)
    return PL.expand(PL.transform(model, train.unionByName(test)), PL.feature_names(model))


@register("l8_fit_transform_train")
def l8_fit_transform_train(spark, sf_dir):
    train, _ = _split(spark, sf_dir)
    model = PL.fit_pipeline("distance", train)
    return PL.transform(model, train)


# ------------------------------------------------------------------- S1-S4

@register("s1_read", sql="SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def s1_read(spark, sf_dir):
    schema = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string"
    return io.read_table(spark, f"{sf_dir}/orders.parquet", schema=schema)


#: Rows of the CSV that don't parse: too few fields, or too many.
_BROKEN = ["7,12", "8,13,44.5,1-URGENT,extra,fields", "9,14,45.5"]


@register("s1_read_csv", sql="SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CAST(NULL AS VARCHAR) AS malformed FROM orders"
          + "".join(f" UNION ALL SELECT NULL, NULL, NULL, NULL, '{r}'" for r in _BROKEN))
def s1_read_csv(spark, sf_dir):
    """A written CSV with three broken rows, read back with inferred types."""
    cols = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    path = _scratch(spark)
    io.write_table(io.read_table(spark, f"{sf_dir}/orders.parquet").select(*cols), path, fmt="csv")
    broken = spark.createDataFrame([(r,) for r in [",".join(cols), *_BROKEN]], "value string")
    broken.coalesce(1).write.mode("append").text(path)
    return io.read_csv(spark, path)


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/loanframe-io-{uuid.uuid4().hex}"


@register("s2_write_csv_roundtrip")
def s2_write_csv_roundtrip(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    model = PL.fit_pipeline("tree", train)
    wide = PL.expand(PL.transform(model, test), PL.feature_names(model))
    path = _scratch(spark)
    io.write_table(wide, path, fmt="csv")
    return io.read_table(spark, path, fmt="csv", schema=wide.schema)


@register("s3_model_save_load")
def s3_model_save_load(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    model = PL.fit_pipeline("tree", train)
    path = _scratch(spark)
    io.save_pipeline(model, path)
    return PL.transform(io.load_pipeline(path), test)


@register("s4_join_labels", sql=L.with_loans(
    "SELECT loan_id, person_income, loan_amnt, loan_status FROM test"))
def s4_join_labels(spark, sf_dir):
    _, test = _split(spark, sf_dir)
    feats = test.select("loan_id", "person_income", "loan_amnt")
    labels = test.select("loan_id", "loan_status")
    return io.join_labels(feats, labels, "loan_id")


@register("l7_chain_steps")
def l7_chain_steps(spark, sf_dir):
    """The fitted chain of named steps of the distance pipeline, in order."""
    train, _ = _split(spark, sf_dir)
    model = PL.fit_pipeline("distance", train)
    rows = [(i, type(st).__name__, ",".join(getattr(st, "input_cols", lambda: [])()))
            for i, st in enumerate(model.stages)]
    return spark.createDataFrame(rows, "position bigint, stage string, input_cols string")


@register("l9_transform_test")
def l9_transform_test(spark, sf_dir):
    """Test rows through the fitted tree pipeline: train constants only."""
    train, test = _split(spark, sf_dir)
    model = PL.fit_pipeline("tree", train)
    return PL.expand(PL.transform(model, test), PL.feature_names(model))


# ------------------------------------------------------------------- X1, X2, X5

@register("x1_global_rank", sql=L.with_loans(
    "SELECT loan_id, CAST(row_number() OVER (ORDER BY person_income, loan_id) AS BIGINT) AS rank FROM dedup"))
def x1_global_rank(spark, sf_dir):
    """Distributed rank by (income, key) without a single-partition window."""
    from loanframe.functions.ordering import global_rank
    d = L.deduped(spark, sf_dir).select("loan_id", "person_income")
    r = global_rank(d.withColumn("_order", F.struct("person_income", "loan_id")), "_order")
    return r.select("loan_id", "rank")


_GRAM_COLS = L.NUMERIC
# amounts in thousands keep the sums at a magnitude where 2 decimals compare; NULL counts as 0
_GX = {c: f"(coalesce(CAST({c} AS DOUBLE), 0.0) / {1000.0 if c in ('person_income', 'loan_amnt') else 1.0})" for c in _GRAM_COLS}
_GRAM_PAIRS = [(a, b) for i, a in enumerate(_GRAM_COLS) for b in _GRAM_COLS[i:]]


@register("x2_gram", sql=L.with_loans(
    "SELECT CAST(loan_status AS INT) AS label, count(*) AS n, "
    + ", ".join(f"sum({_GX[a]} * {_GX[b]}) AS \"{a}*{b}\"" for a, b in _GRAM_PAIRS) + " FROM train GROUP BY 1"),
    rounding={f"{a}*{b}": 2 for a, b in _GRAM_PAIRS})
def x2_gram(spark, sf_dir):
    """Gram matrix X'X of all numeric columns per class."""
    from loanframe.functions.gram import gram_by_group
    train, _ = _split(spark, sf_dir)
    d = train.select(F.col("loan_status").cast("int").cast("string").alias("g"),
                     F.array(*[F.expr(_GX[c]) for c in _GRAM_COLS]).alias("x"))
    gs = gram_by_group(d, "x", group="g", p=len(_GRAM_COLS))
    rows = []
    for g, v in gs.items():
        vals = [float(v["xtx"][_GRAM_COLS.index(a), _GRAM_COLS.index(b)]) for a, b in _GRAM_PAIRS]
        rows.append((int(g), int(v["n"]), *vals))
    names = [f"`{a}*{b}` double" for a, b in _GRAM_PAIRS]
    return spark.createDataFrame(rows, "label int, n bigint, " + ", ".join(names))


@register("x5_inverse_normal", sql=L.with_loans(
    "SELECT loan_id, " + __import__("loanframe.functions.dist", fromlist=["x"]).norm_ppf_sql(
        "(CAST(person_age AS DOUBLE) - 17.5) / 61.0") + " AS z FROM test"), rounding={"z": 12})
def x5_inverse_normal(spark, sf_dir):
    """AS241 as a column expression over a whole table."""
    from loanframe.functions.dist import norm_ppf_col
    _, test = _split(spark, sf_dir)
    return test.select("loan_id", norm_ppf_col((F.col("person_age").cast("double") - 17.5) / 61.0).alias("z"))
