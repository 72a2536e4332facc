"""Labelled rows for the classifiers: which rows may be learnt from, in what number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows a classifier is fitted on at most (12 bytes each where they are broadcast).
MAX_LABELS = 200_000


def remainder(doc_id, mod: int):
    """crc32 of the id as text, modulo ``mod`` (a NULL id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def sample(labels: DataFrame, column: str, mod: int, held_out: int, bound: int = MAX_LABELS) -> DataFrame:
    """(doc_id, label) of rows that may be learnt from: one row an id, at most about ``bound``.

    Left out: rows without id or label, the held-out remainder, and ids with
    differing labels.  Above ``bound`` rows a hash of the id picks a share of
    them, the same at each run; scores and corpus counts don't depend on this bound.
    """
    rows = (labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
            .where(remainder(F.col("doc_id"), mod) != held_out)
            .groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("_most"))
            .where("label = _most").select("doc_id", F.col("label").cast("int").alias("label")))
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(1e6 * bound / n))
    return rows
