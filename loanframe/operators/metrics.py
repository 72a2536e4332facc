"""Binary-classification metrics and curves (K1-K13), grouped by model.

Input: a score table ``(model, key, label, score, prob, prediction)`` with
label and prediction in {0, 1}; ``prob`` may be NULL for score-only models.

Counting metrics (K6-K13) are one grouped aggregate.  Ranking metrics and
curves (K1-K5) first group rows by (model, distinct score) with map-side
partial aggregation, then take running sums with the bucketed primitive X1,
so no single task ever holds a whole model's scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanframe.functions.ordering import running_sums

EPS = 2.220446049250313e-16


def _div(a: Column, b: Column, zero: float | None = 0.0) -> Column:
    out = F.when(b != 0, a / b)
    return out.otherwise(F.lit(zero)) if zero is not None else out


# ------------------------------------------------------------ curves base

def score_groups(scores: DataFrame) -> DataFrame:
    """(model, score, pos, neg) with running sums in ascending score order,
    the per-model totals P and N, and the descending-order counts tps/fps."""
    g = scores.groupBy("model", "score").agg(
        F.sum(F.col("label").cast("long")).alias("pos"),
        F.sum((1 - F.col("label")).cast("long")).alias("neg"))
    r = running_sums(g, "model", "score", ["pos", "neg"], lag=["pos", "neg"])
    tot = r.groupBy("model").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    r = r.join(tot, "model")
    return r.withColumns({"tps": F.col("P") - F.col("cum_pos") + F.col("pos"),
                          "fps": F.col("N") - F.col("cum_neg") + F.col("neg")})


def roc_auc(scores: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """K1: exact ROC AUC per model, ties counted half."""
    b = base if base is not None else score_groups(scores)
    term = F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0)
    return b.groupBy("model").agg(
        _div(F.sum(term), F.first("P").cast("double") * F.first("N"), None).alias("roc_auc"))


def roc_auc_of_runs(runs: DataFrame) -> dict[int, float]:
    """K1 of many models at once: exact ROC AUC by model, ties counted half, NaN where a class has no rows.

    ``runs`` has packed scores (``lockstep.held_out_runs``), the rows of a (model, part) one after another in one partition.
    A task adds up a part of a model's scores; a part tells the driver three numbers.
    """
    def sums(key, some):
        x, pos, neg = (np.concatenate([np.frombuffer(v[i].as_buffer(), kind) for v in some])
                       for i, kind in enumerate(("<f8", "<i4", "<i4")))
        _, at = np.unique(x, return_inverse=True)
        pos, neg = np.bincount(at, weights=pos), np.bincount(at, weights=neg)
        inside = float(np.sum(pos * (np.cumsum(neg) - neg + neg / 2.0)))
        return pa.RecordBatch.from_pylist([{"model": key[0], "part": key[1], "pos": float(pos.sum()), "neg": float(neg.sum()), "inside": inside}],
                                          schema=pa.schema([("model", pa.int32()), ("part", pa.int32()), ("pos", pa.float64()),
                                                            ("neg", pa.float64()), ("inside", pa.float64())]))

    def work(batches):
        at, some = None, []
        for b in batches:
            for key, *v in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), *(b.column(i) for i in (2, 3, 4))):
                if key != at and some:
                    yield sums(at, some)
                    some = []
                at = key
                some.append(v)
        if some:
            yield sums(at, some)

    got: dict[int, list[float]] = {}
    for r in sorted(runs.mapInArrow(work, "model int, part int, pos double, neg double, inside double").collect()):
        of = got.setdefault(r["model"], [0.0, 0.0, 0.0])
        of[2] += r["inside"] + r["pos"] * of[1]                # negatives of the parts below
        of[0] += r["pos"]
        of[1] += r["neg"]
    return {m: s / (p * n) if p and n else float("nan") for m, (p, n, s) in got.items()}


def average_precision(scores: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """K3: sum over thresholds of (R_n - R_(n-1)) * P_n."""
    b = base if base is not None else score_groups(scores)
    term = _div(F.col("pos"), F.col("P")) * _div(F.col("tps"), F.col("tps") + F.col("fps"))
    return b.groupBy("model").agg(F.sum(term).alias("average_precision"))


def roc_curve(scores: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """K2: (model, fpr, tpr, threshold), with the (0, 0, +inf) start point.
    Collinear points are dropped."""
    b = score_groups(scores)
    if drop_intermediate:
        top = (F.col("tps") == F.col("pos")) & (F.col("fps") == F.col("neg"))
        keep = (F.col("pv_pos").isNull() | top
                | (F.col("pv_pos") != F.col("pos")) | (F.col("pv_neg") != F.col("neg")))
        b = b.filter(keep)
    pts = b.select("model", _div(F.col("fps"), F.col("N"), None).alias("fpr"),
                   _div(F.col("tps"), F.col("P"), None).alias("tpr"),
                   F.col("score").alias("threshold"))
    start = scores.select("model").distinct().select(
        "model", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
        F.lit(float("inf")).alias("threshold"))
    return pts.unionByName(start)


def precision_recall_curve(scores: DataFrame) -> DataFrame:
    """K4: (model, precision, recall, threshold) up to full recall, plus the
    closing point (1, 0) with a NULL threshold."""
    b = score_groups(scores).filter(F.col("tps") - F.col("pos") < F.col("P"))
    pts = b.select("model", _div(F.col("tps"), F.col("tps") + F.col("fps"), None).alias("precision"),
                   _div(F.col("tps"), F.col("P"), None).alias("recall"),
                   F.col("score").alias("threshold"))
    end = scores.select("model").distinct().select(
        "model", F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
        F.lit(None).cast("double").alias("threshold"))
    return pts.unionByName(end)


def det_curve(scores: DataFrame) -> DataFrame:
    """K5: (model, fpr, fnr, threshold) from the last point with the top
    false-positive count to the first point with full recall."""
    b = score_groups(scores)
    nx_fps = F.col("fps") + F.col("pv_neg")             # at the next lower threshold
    top = b.groupBy("model").agg(F.max_by("neg", "rank").alias("_fps0"))
    keep = (nx_fps.isNull() | (nx_fps != F.col("_fps0"))) & (F.col("tps") - F.col("pos") < F.col("P"))
    return b.join(top, "model").filter(keep).select(
        "model", _div(F.col("fps"), F.col("N"), None).alias("fpr"),
        _div(F.col("P") - F.col("tps"), F.col("P"), None).alias("fnr"),
        F.col("score").alias("threshold"))


# ------------------------------------------------------------ counting

def confusion_counts(scores: DataFrame) -> DataFrame:
    """Per model: tp, fp, tn, fn in one aggregate."""
    y, p = F.col("label"), F.col("prediction")
    return scores.groupBy("model").agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))


def confusion_matrix(scores: DataFrame) -> DataFrame:
    """K6: (model, label, prediction, count), all four cells present."""
    c = confusion_counts(scores)
    cells = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("prediction"), F.col(n).alias("count"))
                      for a, b, n in ((1, 1, "tp"), (0, 1, "fp"), (0, 0, "tn"), (1, 0, "fn"))])
    return c.select("model", F.inline(cells))


def _rates(c: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.withColumns({
        "prec1": _div(tp, tp + fp), "rec1": _div(tp, tp + fn),
        "prec0": _div(tn, tn + fn), "rec0": _div(tn, tn + fp),
        "sup1": tp + fn, "sup0": tn + fp, "total": tp + fp + tn + fn})


def _f(p: Column, r: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    return _div((1 + b2) * p * r, b2 * p + r)


def classification_report(scores: DataFrame) -> DataFrame:
    """K7: per model, rows for class 0, class 1, accuracy, macro avg and
    weighted avg (precision, recall, f1, support); 0 on zero division."""
    r = _rates(confusion_counts(scores))
    f1, f0 = _f(F.col("prec1"), F.col("rec1")), _f(F.col("prec0"), F.col("rec0"))
    acc = _div(F.col("tp") + F.col("tn"), F.col("total"))
    w1, w0 = _div(F.col("sup1"), F.col("total")), _div(F.col("sup0"), F.col("total"))
    rows = F.array(
        F.struct(F.lit("0").alias("class"), F.col("prec0").alias("precision"), F.col("rec0").alias("recall"),
                 f0.alias("f1"), F.col("sup0").alias("support")),
        F.struct(F.lit("1").alias("class"), F.col("prec1").alias("precision"), F.col("rec1").alias("recall"),
                 f1.alias("f1"), F.col("sup1").alias("support")),
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), acc.alias("f1"), F.col("total").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), ((F.col("prec0") + F.col("prec1")) / 2).alias("precision"),
                 ((F.col("rec0") + F.col("rec1")) / 2).alias("recall"), ((f0 + f1) / 2).alias("f1"),
                 F.col("total").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"),
                 (F.col("prec0") * w0 + F.col("prec1") * w1).alias("precision"),
                 (F.col("rec0") * w0 + F.col("rec1") * w1).alias("recall"),
                 (f0 * w0 + f1 * w1).alias("f1"), F.col("total").alias("support")))
    return r.select("model", F.inline(rows))


def count_metrics(scores: DataFrame, beta: float = 2.0) -> DataFrame:
    """K8 F-beta, K9 balanced accuracy, K10 likelihood ratios, K13 MCC."""
    r = _rates(confusion_counts(scores))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    sens, spec = F.col("rec1"), F.col("rec0")
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return r.select(
        "model",
        _f(F.col("prec1"), F.col("rec1"), beta).alias("fbeta"),
        ((sens + spec) / 2).alias("balanced_accuracy"),
        _div(sens, 1 - spec, None).alias("positive_likelihood_ratio"),
        _div(1 - sens, spec, None).alias("negative_likelihood_ratio"),
        _div(tp * tn - fp * fn, den).alias("matthews_corrcoef"))


def prob_metrics(scores: DataFrame, prob: str = "prob") -> DataFrame:
    """K11 log loss (probabilities clipped to [eps, 1-eps]) and K12 Brier."""
    p = F.least(F.greatest(F.col(prob).cast("double"), F.lit(EPS)), F.lit(1 - EPS))
    y = F.col("label").cast("double")
    ll = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    valid = F.col(prob).isNotNull()
    return scores.groupBy("model").agg(
        F.when(F.count_if(valid) == F.count(F.lit(1)), F.avg(ll)).alias("log_loss"),
        F.when(F.count_if(valid) == F.count(F.lit(1)),
               F.avg((F.col(prob) - y) * (F.col(prob) - y))).alias("brier_score"))


def model_panel_metrics(scores: DataFrame) -> DataFrame:
    """The M20 row per model: roc_auc and pr_auc from ``prob`` when the
    model has one, else from ``score``; log loss and Brier only for
    probability models; Matthews correlation from predictions."""
    has_prob = scores.groupBy("model").agg(
        (F.count_if(F.col("prob").isNotNull()) == F.count(F.lit(1))).alias("_hp"))
    s = scores.join(has_prob, "model").withColumn(
        "score", F.when(F.col("_hp"), F.col("prob")).otherwise(F.col("score"))).drop("_hp")
    base = score_groups(s)
    return (roc_auc(s, base).join(average_precision(s, base).withColumnRenamed("average_precision", "pr_auc"),
                                  "model")
            .join(prob_metrics(scores), "model")
            .join(count_metrics(scores).select("model", "matthews_corrcoef"), "model"))
