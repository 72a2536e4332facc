"""Split, class weights, folds and SMOTE oversampling.

R1 (hash split) lives in ``sources/loans.py``, R3 / R4 in ``models.py``.

R2 SMOTE (Chawla et al. 2002): every synthetic row is x + u * (nn - x) for
a minority row x, one of its k nearest minority neighbours nn and u in
[0, 1).  Neighbours are exact and come from a metric index
(``functions/metric_index.py``), which compares a row with the blocks its
neighbours may be in and with no others.  Choices (which neighbour, u) come
from a hash of (row key, copy number), so the output does not depend on
partitioning or retries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanframe.functions.metric_index import nearest
from loanframe.session import shared_table


def smote(df: DataFrame, features: str = "features", label: str = "label", key: str = "key",
          k: int = 5, minority: int | None = None, seed: int = 42) -> DataFrame:
    """R2: oversample the minority class to the majority size.

    Returns the input rows (``copy`` 0) plus synthetic rows (``synthetic`` =
    true, the key of the row they start from and a ``copy`` from 1: key and
    copy tell rows apart).  Features are an array<double> (booleans already 0/1).
    """
    counts = {int(r[label]): r["count"] for r in df.groupBy(label).count().collect()}
    if len(counts) < 2:
        return df.select(key, F.lit(0).alias("copy"), label, features, F.lit(False).alias("synthetic"))
    mino = minority if minority is not None else min(counts, key=lambda c: (counts[c], c))
    majo = max(counts, key=lambda c: (counts[c], -c))
    n_min, need = counts[mino], counts[majo] - counts[mino]
    base = df.withColumn("synthetic", F.lit(False))
    if need <= 0 or n_min < 2:
        return base.select(key, F.lit(0).alias("copy"), label, features, "synthetic")
    mdf = shared_table(df.filter(F.col(label) == mino).select(key, features), "smote-minority")     # read by five steps
    nn, _ = nearest(mdf, features, key, k)
    # copies per minority row: floor(need / n_min), plus one for the rows
    # whose hash rank falls in the remainder
    per, rem = divmod(need, n_min)
    h = F.xxhash64(F.lit(seed), F.col(key))
    from loanframe.functions.ordering import global_rank
    ranked = global_rank(mdf.withColumn("_h", h), "_h")
    copies = ranked.withColumn("_n", F.lit(per) + F.when(F.col("rank") <= rem, 1).otherwise(0)).filter("_n > 0")
    reps = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    nbr_lists = nn.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("dist", "nbr"))).alias("_nbrs"))
    reps = reps.join(nbr_lists.withColumnRenamed("key", key), key)  # at most k neighbours per row
    pick = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col("_copy")), F.size("_nbrs")).cast("int")
    reps = reps.withColumn("_nbr", F.element_at("_nbrs", pick + 1)["nbr"])
    u = F.pmod(F.xxhash64(F.lit(seed + 2), F.col(key), F.col("_copy")), F.lit(1_000_000_007)) / 1_000_000_007.0
    reps = reps.withColumn("_u", u)
    other = mdf.select(F.col(key).alias("_nbr"), F.col(features).alias("_nf"))
    syn = reps.join(other, "_nbr").select(
        F.col(key), F.col("_copy").cast("int").alias("copy"),
        F.lit(mino).cast(df.schema[label].dataType).alias(label),
        F.zip_with(features, "_nf", lambda a, b: a + F.col("_u") * (b - a)).alias(features),
        F.lit(True).alias("synthetic"))
    return base.select(key, F.lit(0).alias("copy"), label, features, "synthetic").unionByName(syn)


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
