"""Registered queries: metrics and curves on a score table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanframe.functions.dist import norm_ppf_sql
from loanframe.operators import chartdata as C
from loanframe.operators import metrics as K
from loanframe.plans.catalog import register
from loanframe.sources import loans as L


def score_table(spark, sf_dir) -> DataFrame:
    """Two fixed scoring rules on the test rows: 'ratio' (tied scores in
    steps of 0.1, probability by a logistic map) and 'age'."""
    _, test = L.train_test(spark, sf_dir)
    label = F.col("loan_status").cast("int")
    ratio = (F.floor(F.col("loan_amnt") / F.col("person_income") * 10.0).cast("double") / 10.0)
    a = test.select(F.lit("ratio").alias("model"), F.col("loan_id").alias("key"), label.alias("label"),
                    ratio.alias("score"),
                    (F.lit(1.0) / (F.lit(1.0) + F.exp(-(ratio - 8.0)))).alias("prob"),
                    (ratio > 8.0).cast("int").alias("prediction"))
    age = F.col("person_age").cast("double")
    b = test.select(F.lit("age").alias("model"), F.col("loan_id").alias("key"), label.alias("label"),
                    age.alias("score"), ((age - 17.5) / 60.0).alias("prob"),
                    (age > 47.0).cast("int").alias("prediction"))
    return a.unionByName(b)


SCORES_SQL = """, scores AS (
  SELECT 'ratio' AS model, loan_id AS key, CAST(loan_status AS INT) AS label,
         CAST(floor(loan_amnt / person_income * 10.0) AS DOUBLE) / 10.0 AS score,
         1.0 / (1.0 + exp(-(CAST(floor(loan_amnt / person_income * 10.0) AS DOUBLE) / 10.0 - 8.0))) AS prob,
         CAST(CAST(floor(loan_amnt / person_income * 10.0) AS DOUBLE) / 10.0 > 8.0 AS INT) AS prediction
  FROM test
  UNION ALL
  SELECT 'age', loan_id, CAST(loan_status AS INT), CAST(person_age AS DOUBLE),
         (CAST(person_age AS DOUBLE) - 17.5) / 60.0, CAST(CAST(person_age AS DOUBLE) > 47.0 AS INT)
  FROM test),
g AS (SELECT model, score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg
      FROM scores GROUP BY model, score),
c AS (SELECT *,
        sum(pos) OVER (PARTITION BY model ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_pos,
        sum(neg) OVER (PARTITION BY model ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_neg,
        sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N,
        row_number() OVER (PARTITION BY model ORDER BY score) AS rank,
        count(*) OVER (PARTITION BY model) AS top,
        lag(pos) OVER (PARTITION BY model ORDER BY score) AS nx_pos,
        lag(neg) OVER (PARTITION BY model ORDER BY score) AS nx_neg
      FROM g),
d AS (SELECT *, P - cum_pos + pos AS tps, N - cum_neg + neg AS fps FROM c),
cm AS (SELECT model, count_if(label = 1 AND prediction = 1) AS tp, count_if(label = 0 AND prediction = 1) AS fp,
              count_if(label = 0 AND prediction = 0) AS tn, count_if(label = 1 AND prediction = 0) AS fn
       FROM scores GROUP BY model),
r AS (SELECT *,
        CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS prec1,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rec1,
        CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS prec0,
        CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS rec0,
        tp + fn AS sup1, tn + fp AS sup0, tp + fp + tn + fn AS total
      FROM cm),
rf AS (SELECT *,
        CASE WHEN prec1 + rec1 > 0 THEN 2 * prec1 * rec1 / (prec1 + rec1) ELSE 0.0 END AS f1,
        CASE WHEN prec0 + rec0 > 0 THEN 2 * prec0 * rec0 / (prec0 + rec0) ELSE 0.0 END AS f0
      FROM r)
"""


def _sql(select: str) -> str:
    return L.with_loans(SCORES_SQL + select)


@register("k1_roc_auc", sql=_sql(
    "SELECT model, sum(pos * (cum_neg - neg + neg / 2.0)) / (CAST(max(P) AS DOUBLE) * CAST(max(N) AS DOUBLE))"
    " AS roc_auc FROM d GROUP BY model"), rounding={"roc_auc": 9})
def k1_roc_auc(spark, sf_dir):
    return K.roc_auc(score_table(spark, sf_dir))


@register("k2_roc_curve", sql=_sql(
    "SELECT model, fps / N AS fpr, tps / P AS tpr, score AS threshold FROM d"
    " WHERE rank = 1 OR rank = top OR nx_pos <> pos OR nx_neg <> neg"
    " UNION ALL SELECT DISTINCT model, 0.0, 0.0, 'inf'::DOUBLE FROM scores"), rounding={"fpr": 12, "tpr": 12})
def k2_roc_curve(spark, sf_dir):
    return K.roc_curve(score_table(spark, sf_dir))


@register("k3_average_precision", sql=_sql(
    "SELECT model, sum(pos / P * tps / (tps + fps)) AS average_precision FROM d GROUP BY model"),
    rounding={"average_precision": 9})
def k3_average_precision(spark, sf_dir):
    return K.average_precision(score_table(spark, sf_dir))


@register("k4_pr_curve", sql=_sql(
    "SELECT model, tps / (tps + fps) AS precision, tps / P AS recall, score AS threshold FROM d"
    " WHERE tps - pos < P UNION ALL SELECT DISTINCT model, 1.0, 0.0, CAST(NULL AS DOUBLE) FROM scores"),
    rounding={"precision": 12, "recall": 12})
def k4_pr_curve(spark, sf_dir):
    return K.precision_recall_curve(score_table(spark, sf_dir))


@register("k5_det_curve", sql=_sql(
    ", e AS (SELECT *, lag(fps) OVER (PARTITION BY model ORDER BY score) AS nx_fps,"
    " max_by(fps, rank) OVER (PARTITION BY model) AS fps0 FROM d)"
    " SELECT model, fps / N AS fpr, (P - tps) / P AS fnr, score AS threshold FROM e"
    " WHERE (nx_fps IS NULL OR nx_fps <> fps0) AND tps - pos < P"), rounding={"fpr": 12, "fnr": 12})
def k5_det_curve(spark, sf_dir):
    return K.det_curve(score_table(spark, sf_dir))


@register("k6_confusion_matrix", sql=_sql(
    "SELECT model, 1 AS label, 1 AS prediction, tp AS count FROM cm UNION ALL"
    " SELECT model, 0, 1, fp FROM cm UNION ALL SELECT model, 0, 0, tn FROM cm UNION ALL"
    " SELECT model, 1, 0, fn FROM cm"))
def k6_confusion_matrix(spark, sf_dir):
    return K.confusion_matrix(score_table(spark, sf_dir))


_REPORT = {"precision": 9, "recall": 9, "f1": 9}


@register("k7_classification_report", sql=_sql(
    "SELECT model, '0' AS class, prec0 AS precision, rec0 AS recall, f0 AS f1, sup0 AS support FROM rf"
    " UNION ALL SELECT model, '1', prec1, rec1, f1, sup1 FROM rf"
    " UNION ALL SELECT model, 'accuracy', NULL, NULL, (tp + tn) / total, total FROM rf"
    " UNION ALL SELECT model, 'macro avg', (prec0 + prec1) / 2, (rec0 + rec1) / 2, (f0 + f1) / 2, total FROM rf"
    " UNION ALL SELECT model, 'weighted avg', prec0 * sup0 / total + prec1 * sup1 / total,"
    " rec0 * sup0 / total + rec1 * sup1 / total, f0 * sup0 / total + f1 * sup1 / total, total FROM rf"),
    rounding=_REPORT)
def k7_classification_report(spark, sf_dir):
    return K.classification_report(score_table(spark, sf_dir))


@register("k8_fbeta", sql=_sql(
    "SELECT model, CASE WHEN 4 * prec1 + rec1 > 0 THEN 5 * prec1 * rec1 / (4 * prec1 + rec1) ELSE 0.0 END"
    " AS fbeta FROM r"), rounding={"fbeta": 9})
def k8_fbeta(spark, sf_dir):
    return K.count_metrics(score_table(spark, sf_dir), beta=2.0).select("model", "fbeta")


@register("k9_balanced_accuracy", sql=_sql("SELECT model, (rec1 + rec0) / 2 AS balanced_accuracy FROM r"),
          rounding={"balanced_accuracy": 9})
def k9_balanced_accuracy(spark, sf_dir):
    return K.count_metrics(score_table(spark, sf_dir)).select("model", "balanced_accuracy")


@register("k10_likelihood_ratios", sql=_sql(
    "SELECT model, CASE WHEN 1 - rec0 <> 0 THEN rec1 / (1 - rec0) END AS positive_likelihood_ratio,"
    " CASE WHEN rec0 <> 0 THEN (1 - rec1) / rec0 END AS negative_likelihood_ratio FROM r"),
    rounding={"positive_likelihood_ratio": 9, "negative_likelihood_ratio": 9})
def k10_likelihood_ratios(spark, sf_dir):
    return K.count_metrics(score_table(spark, sf_dir)).select(
        "model", "positive_likelihood_ratio", "negative_likelihood_ratio")


def _ll_sql(p: str) -> str:
    q = f"least(greatest(CAST({p} AS DOUBLE), {K.EPS!r}), {1 - K.EPS!r})"
    return f"avg(-(label * ln({q}) + (1 - label) * ln(1 - {q})))"


@register("k11_log_loss", sql=_sql(f"SELECT model, {_ll_sql('prob')} AS log_loss FROM scores GROUP BY model"),
          rounding={"log_loss": 9})
def k11_log_loss(spark, sf_dir):
    return K.prob_metrics(score_table(spark, sf_dir)).select("model", "log_loss")


@register("k11_log_loss_labels",
          sql=_sql(f"SELECT model, {_ll_sql('prediction')} AS log_loss FROM scores GROUP BY model"),
          rounding={"log_loss": 9})
def k11_log_loss_labels(spark, sf_dir):
    s = score_table(spark, sf_dir).withColumn("prob", F.col("prediction").cast("double"))
    return K.prob_metrics(s).select("model", "log_loss")


@register("k12_brier", sql=_sql(
    "SELECT model, avg((prob - label) * (prob - label)) AS brier_score FROM scores GROUP BY model"),
    rounding={"brier_score": 9})
def k12_brier(spark, sf_dir):
    return K.prob_metrics(score_table(spark, sf_dir)).select("model", "brier_score")


@register("k13_matthews", sql=_sql(
    "SELECT model, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN"
    " (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn)"
    " * (tn + fp) * (tn + fn)) ELSE 0.0 END AS matthews_corrcoef FROM cm"), rounding={"matthews_corrcoef": 9})
def k13_matthews(spark, sf_dir):
    return K.count_metrics(score_table(spark, sf_dir)).select("model", "matthews_corrcoef")


@register("c8_roc_display", sql=_sql(
    "SELECT model, fps / N AS fpr, tps / P AS tpr, score AS threshold FROM d"
    " WHERE rank = 1 OR rank = top OR nx_pos <> pos OR nx_neg <> neg"
    " UNION ALL SELECT DISTINCT model, 0.0, 0.0, 'inf'::DOUBLE FROM scores"), rounding={"fpr": 12, "tpr": 12})
def c8_roc_display(spark, sf_dir):
    return K.roc_curve(score_table(spark, sf_dir))


@register("c8_pr_display", sql=_sql(
    ", ap AS (SELECT model, sum(pos / P * tps / (tps + fps)) AS average_precision, max(P) / (max(P) + max(N)) AS chance FROM d GROUP BY model),"
    " curve AS (SELECT model, tps / (tps + fps) AS precision, tps / P AS recall, score AS threshold FROM d"
    " WHERE tps - pos < P UNION ALL SELECT DISTINCT model, 1.0, 0.0, CAST(NULL AS DOUBLE) FROM scores)"
    " SELECT model, precision, recall, threshold, average_precision, chance FROM curve JOIN ap USING (model)"),
    rounding={"precision": 12, "recall": 12, "average_precision": 9, "chance": 12})
def c8_pr_display(spark, sf_dir):
    return C.pr_display(score_table(spark, sf_dir))


def _deviate_sql(x: str) -> str:
    return f"CASE WHEN {x} > 0 AND {x} < 1 THEN {norm_ppf_sql(f'(CASE WHEN {x} > 0 AND {x} < 1 THEN {x} ELSE 0.5 END)')} END"


@register("c8_det_display", sql=_sql(
    ", e AS (SELECT *, lag(fps) OVER (PARTITION BY model ORDER BY score) AS nx_fps,"
    " max_by(fps, rank) OVER (PARTITION BY model) AS fps0 FROM d),"
    " curve AS (SELECT model, score AS threshold, fps / N AS fpr, (P - tps) / P AS fnr FROM e"
    " WHERE (nx_fps IS NULL OR nx_fps <> fps0) AND tps - pos < P)"
    f" SELECT model, threshold, {_deviate_sql('fpr')} AS x, {_deviate_sql('fnr')} AS y FROM curve"), rounding={"x": 9, "y": 9})
def c8_det_display(spark, sf_dir):
    return C.det_display(score_table(spark, sf_dir))


@register("c8_confusion_display", sql=_sql(
    ", cells AS (SELECT model, 1 AS label, 1 AS prediction, tp AS count FROM cm UNION ALL"
    " SELECT model, 0, 1, fp FROM cm UNION ALL SELECT model, 0, 0, tn FROM cm UNION ALL SELECT model, 1, 0, fn FROM cm)"
    " SELECT *, count / sum(count) OVER (PARTITION BY model, label) AS share_of_label,"
    " count / sum(count) OVER (PARTITION BY model, prediction) AS share_of_prediction,"
    " count / sum(count) OVER (PARTITION BY model) AS share_of_all FROM cells"),
    rounding={"share_of_label": 12, "share_of_prediction": 12, "share_of_all": 12})
def c8_confusion_display(spark, sf_dir):
    return C.confusion_display(score_table(spark, sf_dir))


@register("c7_class_counts", sql=L.with_loans(
    "SELECT CAST(loan_status AS INT) AS label, count(*) AS count FROM train GROUP BY 1"))
def c7_class_counts(spark, sf_dir):
    train, _ = L.train_test(spark, sf_dir)
    return train.groupBy(F.col("loan_status").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("count"))
