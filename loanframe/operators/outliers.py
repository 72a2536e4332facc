"""Quantiles and outliers.

Quantiles are exact at any size (``functions/quantile.py``, linear
interpolation, the same numbers as DuckDB ``quantile_cont``): one method for
the operators, the fitted stages and the registered queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanframe.functions.quantile import quantiles
from loanframe.operators.base import FitEstimator, FittedModel


def quartile_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """O1 + O2 as a DataFrame: column, q1, q3, iqr, lower, upper (fold 1.5)."""
    rows = [(c, *q) for c, q in quantiles(df, cols, [0.25, 0.75]).items()]
    t = df.sparkSession.createDataFrame(rows, "column string, q1 double, q3 double")
    t = t.withColumn("iqr", F.col("q3") - F.col("q1"))
    return (t.withColumn("lower", F.col("q1") - F.col("iqr") * 1.5)
            .withColumn("upper", F.col("q3") + F.col("iqr") * 1.5))


def iqr_fences(df: DataFrame, cols: list[str], fold: float = 1.5) -> dict[str, tuple[float | None, float | None]]:
    """O2 as driver constants."""
    q = quantiles(df, cols, [0.25, 0.75])
    out = {}
    for c, (q1, q3) in q.items():
        if q1 is None:
            out[c] = (None, None)
        else:
            out[c] = (q1 - (q3 - q1) * fold, q3 + (q3 - q1) * fold)
    return out


def _counts_long(df: DataFrame, conds: dict) -> DataFrame:
    row = df.agg(*[F.count_if(cond).alias(f"_c{i}") for i, cond in enumerate(conds.values())])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("outlier_count"))
                      for i, c in enumerate(conds)])
    return row.select(F.inline(items))


def iqr_outlier_counts(df: DataFrame, cols: list[str], fold: float = 1.5) -> DataFrame:
    """O3: rows outside the IQR fences, per column: the quantiles, then one
    counting aggregate with the fences as literals."""
    fences = iqr_fences(df, cols, fold)
    conds = {}
    for c in cols:
        lo, hi = fences[c]
        conds[c] = (F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi)) if lo is not None else F.lit(False)
    return _counts_long(df, conds)


def sorted_counts(counts: DataFrame) -> DataFrame:
    """The count table in ascending order."""
    return counts.orderBy("outlier_count", "column")


def zscore_outlier_counts(df: DataFrame, cols: list[str], threshold: float = 3.0,
                          two_tailed: bool = False) -> DataFrame:
    """Rows with z = (x - mean) / population sd above ``threshold``
    (upper tail only, as cited; ``two_tailed`` uses |z|).  NULLs are left out."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"_s{i}")
                   for i, c in enumerate(cols)]).first()
    conds = {}
    for i, c in enumerate(cols):
        m, s = row[f"_m{i}"], row[f"_s{i}"]
        if m is None or not s:
            conds[c] = F.lit(False)
            continue
        z = (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
        conds[c] = (F.abs(z) > threshold) if two_tailed else (z > threshold)
    return _counts_long(df, conds)


# ------------------------------------------------------------------- O6

class WinsorizerModel(FittedModel):
    def apply(self, df, state):
        out = {}
        for c in self.input_cols():
            lo, hi = state["fences"][c]
            x = F.col(c)
            if lo is None:
                continue
            # greatest/least skip NULLs: guard so a NULL stays NULL
            out[c] = F.when(x.isNull(), x).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
        return df.withColumns(out)


class Winsorizer(FitEstimator):
    """Fit IQR fences on train, clip both tails of any frame."""
    model_class = WinsorizerModel

    def __init__(self, inputCols=None, fold: float = 1.5):
        super().__init__(inputCols, fold=fold)

    def fit_state(self, df, cols, opts):
        f = iqr_fences(df, cols, opts.get("fold", 1.5))
        return {"fences": {c: list(v) for c, v in f.items()}}
