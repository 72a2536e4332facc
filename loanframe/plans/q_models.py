"""Registered queries: models, selection, tuning, split and resampling."""

from __future__ import annotations

import threading

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanframe.functions.gram import Interactions
from loanframe.operators import models as M
from loanframe.operators import tune as TU
from loanframe.operators.numeric import products
from loanframe.operators.online import fit_online
from loanframe.operators.svm import fit_linear_svc
from loanframe.plans import pipelines as PL
from loanframe.plans.catalog import register
from loanframe.session import shared_table
from loanframe.sources import loans as L

_MEMO: dict = {}
_LOCK = threading.Lock()


def _base(spark, sf_dir) -> tuple[DataFrame, PipelineModel]:
    """X_linear before its interactions, as (key, label, base, is_test), stored once a session and folder with the
    fitted pipeline: models read this table, not the sources."""
    k = (spark.sparkContext.applicationId, sf_dir)
    with _LOCK:
        if k not in _MEMO:
            loans = L.deduped(spark, sf_dir).withColumn("is_test", L.is_test()).persist()
            try:
                pm = PL.fit_pipeline("linear", loans.where("NOT is_test"))
                rows = PL.base_columns(pm, loans, keep=[L.KEY, L.LABEL, "is_test"])
                rows = shared_table(rows.select(F.col(L.KEY).alias("key"), F.col(L.LABEL).cast("int").alias("label"),
                                                "is_test", "base"), "x-linear")
            finally:
                loans.unpersist()
            _MEMO[k] = rows, pm
    return _MEMO[k]


def base_data(spark, sf_dir) -> tuple[DataFrame, DataFrame, Interactions]:
    """Train and test rows (key, label, base) and the features that their base columns stand for."""
    rows, pm = _base(spark, sf_dir)
    return (rows.where("NOT is_test").drop("is_test"), rows.where("is_test").drop("is_test"), PL.interactions(pm))


def model_data(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[str]]:
    """The linear pipeline's train and test features (X_*_linear + labels), as (key, label, features)."""
    _, pm = _base(spark, sf_dir)
    train, test, made = base_data(spark, sf_dir)
    p = len(pm.stages[-2].input_cols())

    def feats(d):
        d = d.select("key", "label", products(F.col("base"), p, True).alias("features"))
        return pm.stages[-1].transform(d)
    return feats(train), feats(test), PL.feature_names(pm)


def _scores_of_sums(fit):
    """Models fitted from base columns: features are made where they are used."""
    def run(spark, sf_dir):
        tr, te, made = base_data(spark, sf_dir)
        return fit(tr, made).score(te, features="base", expand=made)
    return run


for _key, _sums in {
    "m6_ridge": lambda d, made: M.fit_ridge(d, features="base", expand=made),
    "m7_ridge_cv": lambda d, made: M.fit_ridge_cv(d, features="base", expand=made, p=made.width()),
    "m12_lda": lambda d, made: M.fit_lda(d, features="base", expand=made),
    "m8_sgd_log": lambda d, made: fit_online(d, "log", features="base", expand=made),
    "m9_sgd_hinge": lambda d, made: fit_online(d, "hinge", features="base", expand=made),
    "m10_perceptron": lambda d, made: fit_online(d, "perceptron", features="base", expand=made),
    "m11_passive_aggressive": lambda d, made: fit_online(d, "pa", features="base", expand=made),
}.items():
    register(_key)(_scores_of_sums(_sums))

for _key, _fit in {
    "m2_logreg_cv_l1": lambda d, made: M.fit_logistic_cv(d, "l1", features="base", expand=made),
    "m3_logreg_cv_l2": lambda d, made: M.fit_logistic_cv(d, "l2", features="base", expand=made),
    "m4_logreg_cv_elasticnet": lambda d, made: M.fit_logistic_cv(d, "elasticnet", l1_ratio=0.5, features="base", expand=made),
    "m5_logreg": lambda d, made: M.fit_logistic(d, features="base", expand=made),
    "m13_linear_svc": lambda d, made: fit_linear_svc(d, features="base", expand=made),
    "m14_linear_svc_l1_balanced": lambda d, made: fit_linear_svc(d, C=1.0, penalty="l1", weights=M.class_weights(d),
                                                                 max_iter=50, features="base", expand=made),
}.items():
    register(_key)(_scores_of_sums(_fit))

register("m1_dummy", sql=L.with_loans(
    ", top AS (SELECT CAST(loan_status AS INT) AS c FROM train GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    " SELECT 'DummyClassifier' AS model, loan_id AS key, CAST(loan_status AS INT) AS label,"
    " CAST(CASE WHEN c = 1 THEN 1 ELSE -1 END AS DOUBLE) AS score, CAST(c AS DOUBLE) AS prob, c AS prediction FROM test, top"))(
    _scores_of_sums(lambda d, made: M.fit_dummy(d)))


@register("m15_select_from_model")
def m15_select_from_model(spark, sf_dir):
    tr, _, made = base_data(spark, sf_dir)
    names = PL.feature_names(_base(spark, sf_dir)[1])
    keep, m = TU.select_from_l1(tr, features="base", expand=made)
    return spark.createDataFrame([(i, names[i], float(m.w[i])) for i in keep],
                                 "position bigint, name string, coef double")


@register("m16_select_then_classify")
def m16_select_then_classify(spark, sf_dir):
    tr, te, made = base_data(spark, sf_dir)
    return TU.SelectThenClassify().fit(tr, "base", made).score(te, features="base", expand=made)


@register("m17_grid_select_l2")
def m17_grid_select_l2(spark, sf_dir):
    tr, _, made = base_data(spark, sf_dir)
    return TU.grid_l2(tr, features="base", expand=made)[0]


@register("m18_grid_l1")
def m18_grid_l1(spark, sf_dir):
    tr, _, made = base_data(spark, sf_dir)
    return TU.grid_l1(tr, features="base", expand=made)[0]


@register("m19_grid_svc_l1")
def m19_grid_svc_l1(spark, sf_dir):
    tr, _, made = base_data(spark, sf_dir)
    return TU.grid_svc(tr, features="base", expand=made)[0]


@register("m20_compare_models")
def m20_compare_models(spark, sf_dir):
    tr, te, made = base_data(spark, sf_dir)
    return TU.compare_models(tr, te, features="base", expand=made)


@register("m21_top_models")
def m21_top_models(spark, sf_dir):
    tr, te, made = base_data(spark, sf_dir)
    return TU.top_models(TU.compare_models(tr, te, features="base", expand=made), 5)


@register("m22_score")
def m22_score(spark, sf_dir):
    """Batch scoring job: features + fitted model -> class, score, probability."""
    tr, te, made = base_data(spark, sf_dir)
    m = M.fit_logistic(tr, features="base", expand=made)
    return m.score(te, features="base", expand=made).select("key", "prediction", "score", "prob")


# ------------------------------------------------------------ R1, R3, R4

@register("r1_split", sql=L.with_loans(f"SELECT loan_id, {L.is_test_sql()} AS is_test FROM dedup"))
def r1_split(spark, sf_dir):
    return L.deduped(spark, sf_dir).select("loan_id", L.is_test().alias("is_test"))


@register("r3_class_weights", sql=L.with_loans(
    "SELECT CAST(loan_status AS INT) AS label, count(*) AS count,"
    " (SELECT count(*) FROM train) / (2.0 * count(*)) AS weight FROM train GROUP BY 1"),
    rounding={"weight": 12})
def r3_class_weights(spark, sf_dir):
    train, _ = L.train_test(spark, sf_dir)
    d = train.select(F.col(L.LABEL).cast("int").alias("label"))
    w = M.class_weights(d)
    counts = d.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("weight", F.when(F.col("label") == 1, F.lit(w.get(1))).otherwise(F.lit(w.get(0))))


@register("r4_fold_sizes", sql=L.with_loans(
    ", c AS (SELECT CAST(loan_status AS INT) AS label, count(*) AS n FROM train GROUP BY 1),"
    " f AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold)"
    " SELECT label, CAST(fold AS INT) AS fold, CAST((n + 4 - fold) // 5 AS BIGINT) AS count FROM c, f"))
def r4_fold_sizes(spark, sf_dir):
    train, _ = L.train_test(spark, sf_dir)
    d = train.select(F.col(L.KEY).alias("key"), F.col(L.LABEL).cast("int").alias("label"))
    f = M.stratified_folds(d, 5)
    return f.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("count"))


# ------------------------------------------------------------ R2, R5

def _smote_input(spark, sf_dir):
    """X_train with one-hot categories (no drop) and imputed numerics, as
    the cited SMOTE cell builds it (flags dropped first)."""
    from loanframe.operators.encode import OneHotEncoder
    from loanframe.operators.impute import IterativeImputer
    from loanframe.operators.numeric import Assemble
    train, _ = L.train_test(spark, sf_dir)
    # the fits and SMOTE read these rows many times: the join and the de-duplication run once
    d = shared_table(PL.prepare(train).select(L.KEY, L.LABEL, *PL.NUMERIC, *PL.CATEGORY), "smote-train")
    d = IterativeImputer(PL.NUMERIC).fit(d).transform(d)
    oh = OneHotEncoder(PL.CATEGORY).fit(d)
    d = oh.transform(d)
    names = PL.NUMERIC + oh.output_cols()[len(oh.opts().get("passthrough", [])):]
    return Assemble(names, keep=[L.KEY, L.LABEL]).transform(d).select(
        F.col(L.KEY).alias("key"), F.col(L.LABEL).cast("int").alias("label"), "features")


@register("r2_smote")
def r2_smote(spark, sf_dir):
    from loanframe.operators.sampling import smote
    return smote(_smote_input(spark, sf_dir))


@register("r5_class_balance_after_smote", sql=L.with_loans(
    ", c AS (SELECT CAST(loan_status AS INT) AS label, count(*) AS n FROM train GROUP BY 1)"
    " SELECT label, (SELECT max(n) FROM c) AS count FROM c"))
def r5_class_balance_after_smote(spark, sf_dir):
    from loanframe.operators.sampling import class_balance, smote
    return class_balance(smote(_smote_input(spark, sf_dir)))
