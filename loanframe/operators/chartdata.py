"""The table behind each cited plot (C1, C3, C4, C8); no drawing.

C2, C5, C6 are profile tables (``profile.py``), C7 is the class count, the
ROC display of C8 is the curve of ``metrics.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanframe.functions.dist import norm_ppf_col
from loanframe.functions.ordering import running_sums
from loanframe.functions.quantile import quantiles
from loanframe.operators import metrics as K

VIOLIN_PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


def grouped_summary(df: DataFrame, value: str, group: str, probs: list[float] = VIOLIN_PROBS) -> DataFrame:
    """Per group count, min, max and exact quantiles of a numeric column."""
    d = df.select(F.col(group).alias("group"), F.col(value).cast("double").alias("x"))
    g = d.groupBy("group").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"))
    levels = [r["group"] for r in g.select("group").collect()]      # the violins of one plot
    wide = d.select(*[F.when(F.col("group").eqNullSafe(F.lit(v)), F.col("x")).alias(f"g{i}") for i, v in enumerate(levels)])
    q = quantiles(wide, wide.columns, probs)
    names = [f"q{int(round(p * 100)):02d}" for p in probs]
    kind = dict(g.dtypes)["group"]
    t = df.sparkSession.createDataFrame([(v, *q[f"g{i}"]) for i, v in enumerate(levels)],
                                        ", ".join([f"`_level` {kind}", *[f"{n} double" for n in names]]))
    return g.join(t, F.col("group").eqNullSafe(F.col("_level"))).select(
        F.lit(value).alias("variable"), F.lit(group).alias("by"), "group", "n", "min", "max", *names)


def grouped_histogram(df: DataFrame, value: str, group: str, bins: int = 30) -> DataFrame:
    """Counts of a numeric column in equal bins of its whole range, per group (the outline of each violin)."""
    d = df.select(F.col(group).alias("group"), F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    r = d.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    lo = r["a"] if r["a"] is not None else 0.0
    width = ((r["b"] - r["a"]) / bins if r["a"] is not None else 0.0) or 1.0
    b = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    return d.groupBy("group", b.alias("bin")).agg(F.count("*").alias("count")).select(
        F.lit(value).alias("variable"), F.lit(group).alias("by"), "group", "bin", "count")


def histogram(df: DataFrame, cols: list[str], bins: int = 30, stage: str = "raw") -> DataFrame:
    """Fixed-width histogram of many columns in two passes (min/max,
    then one grouped count of (column, bin) over an unpivot)."""
    r = df.agg(*[F.min(F.col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
               *[F.max(F.col(c).cast("double")).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    items = []
    for i, c in enumerate(cols):
        lo, hi = r[f"a{i}"], r[f"b{i}"]
        if lo is None:
            continue
        width = (hi - lo) / bins if hi > lo else 1.0
        x = F.col(c).cast("double")
        # least() skips NULLs: guard, or a NULL would land in the last bin
        b = F.when(x.isNotNull(), F.least(F.floor((x - F.lit(lo)) / F.lit(width)),
                                          F.lit(bins - 1))).cast("bigint")
        items.append(F.struct(F.lit(c).alias("variable"), b.alias("bin"),
                              (F.lit(lo) + b * F.lit(width)).alias("bin_lo"),
                              (F.lit(lo) + (b + 1) * F.lit(width)).alias("bin_hi")))
    t = df.select(F.inline(F.array(*items))).filter(F.col("bin").isNotNull())
    return t.groupBy("variable", "bin", "bin_lo", "bin_hi").agg(F.count(F.lit(1)).alias("count")).withColumn(
        "stage", F.lit(stage))


def qq_points(df: DataFrame, cols: list[str]) -> DataFrame:
    """C4: normal Q-Q points of every value: its plotting position
    (rank - 0.5) / n and the AS241 normal quantile there.  Equal values are
    one point, at the middle of their ranks, with their count."""
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("sample")) for c in cols]))
    t = df.select(x.alias("s")).select("s.*").where("sample IS NOT NULL").groupBy("variable", "sample").agg(
        F.count("*").alias("n"))
    total = t.groupBy("variable").agg(F.sum("n").alias("_all"))
    r = running_sums(t, "variable", "sample", ["n"]).join(F.broadcast(total), "variable")    # one row a column
    r = r.withColumn("prob", (F.col("cum_n") - F.col("n") / 2.0) / F.col("_all"))
    return r.select("variable", "sample", "n", "prob", norm_ppf_col(F.col("prob")).alias("theoretical"))


# ------------------------------------------------------------------- C8

def pr_display(scores: DataFrame) -> DataFrame:
    """The precision-recall curve with what its display is labelled with: average precision, and the share of
    positives, at which a model without skill runs."""
    ap = K.average_precision(scores)
    share = scores.groupBy("model").agg(F.avg(F.col("label").cast("double")).alias("chance"))
    return K.precision_recall_curve(scores).join(F.broadcast(ap.join(share, "model")), "model")      # a row a model


def det_display(scores: DataFrame) -> DataFrame:
    """The DET curve in normal deviates, the scale its display has; rates of 0 or 1 have no place there (NULL)."""
    def deviate(c: str):
        return F.when((F.col(c) > 0) & (F.col(c) < 1), norm_ppf_col(F.col(c)))
    return K.det_curve(scores).select("model", "threshold", deviate("fpr").alias("x"), deviate("fnr").alias("y"))


def confusion_display(scores: DataFrame) -> DataFrame:
    """The cells of the confusion matrix with their shares of the true class, of the predicted class and of all rows."""
    cells = K.confusion_matrix(scores)
    by = {"share_of_label": ["model", "label"], "share_of_prediction": ["model", "prediction"], "share_of_all": ["model"]}
    for name, keys in by.items():                               # windows over four cells a model
        total = F.sum("count").over(W.partitionBy(*keys))
        cells = cells.withColumn(name, F.when(total > 0, F.col("count") / total))
    return cells
