"""Distributed rank, running sums and neighbours.

A window over a whole group puts the group into one task.  Here rows are
dealt to ranges of (group, order) by ``repartitionByRange``, so every
partition has about the same number of rows whatever the groups' sizes, and
the ranges are fixed by writing them to the shared folder with their number.
Sums run inside a partition; what a group has in earlier partitions is one
row a partition (the group that its first rows belong to), so the driver
holds two rows a partition and never a row of data.  NULL groups and NULL
order keys are values like others (NULL sorts first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanframe.session import shared_table


def running_sums(df: DataFrame, group: str | None, order: str, sums: list[str],
                 lag: list[str] | None = None) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum of c by ``order`` ascending,
    within ``group``), ``rank`` (1-based position) and, for the columns in
    ``lag``, ``pv_<c>`` (c in the row before it in the group, NULL in its first).

    ``order`` values should be distinct within a group (group by the order
    key first, as the metrics do).  Ties are put in the order of a hash of
    the row, so that equal keys need not share a partition.
    """
    lag = lag or []
    keys = [*([group] if group else []), order]
    d = df.withColumn("_tie", F.xxhash64(*df.columns))
    d = shared_table(d.repartitionByRange(*keys, "_tie").withColumn("_part", F.spark_partition_id()), "ordered")
    g = F.struct(F.col(group)) if group else F.struct(F.lit(0).alias("all"))
    d = d.withColumn("_group", g)
    at = F.struct(*keys, "_tie")
    # two rows a partition: totals of its first and last group, and its last row
    ends = d.groupBy("_part").agg(F.min("_group").alias("g0"), F.max("_group").alias("g1"),
                                  F.max_by(F.struct("_group", *lag), at).alias("end"))
    totals = d.groupBy("_part", "_group").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(sums)])
    edge = (totals.join(ends, "_part").where((F.col("_group") == F.col("g0")) | (F.col("_group") == F.col("g1")))
            .orderBy("_part", "_group").collect())
    carry, offsets, before, part = {}, [], None, None
    for r in edge:
        old = carry.get("sums") if carry.get("group") == r["_group"] else [0] * (len(sums) + 1)
        if r["_part"] != part:
            offsets.append((r["_part"], r["_group"], before["_group"] if before else None, *old,
                            *[before[c] if before else None for c in lag]))
            part, before = r["_part"], r["end"]
        new = [r["n"], *[r[f"s{i}"] for i in range(len(sums))]]
        carry = {"group": r["_group"], "sums": [a + (b or 0) for a, b in zip(old, new)]}
    types = dict(d.dtypes)
    summed = dict(totals.dtypes)
    spec = ", ".join(["_part int", f"_og {types['_group']}", f"_bg {types['_group']}", "_on bigint",
                      *[f"_o{i} {summed[f's{i}']}" for i in range(len(sums))], *[f"_p{i} {types[c]}" for i, c in enumerate(lag)]])
    small = df.sparkSession.createDataFrame(offsets, spec)          # one row a partition
    inside = W.partitionBy("_part", "_group").orderBy(order, "_tie")
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = d.withColumn("rank", F.count(F.lit(1)).over(upto)).withColumns({f"cum_{c}": F.sum(c).over(upto) for c in sums})
    out = out.withColumns({f"pv_{c}": F.lag(c).over(inside) for c in lag})
    out = out.withColumn("_first", F.col("rank") == 1)
    out = out.join(F.broadcast(small), "_part")
    mine = F.col("_group") == F.col("_og")
    out = out.withColumn("rank", (F.col("rank") + F.when(mine, F.col("_on")).otherwise(0)).cast("bigint"))
    out = out.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.when(mine, F.col(f"_o{i}")).otherwise(0)
                           for i, c in enumerate(sums)})
    out = out.withColumns({f"pv_{c}": F.when(F.col("_first"), F.when(F.col("_group") == F.col("_bg"), F.col(f"_p{i}")))
                           .otherwise(F.col(f"pv_{c}")) for i, c in enumerate(lag)})
    return out.select(*df.columns, *[f"cum_{c}" for c in sums], "rank", *[f"pv_{c}" for c in lag])


def global_rank(df: DataFrame, order: str, group: str | None = None) -> DataFrame:
    """1-based rank of each row by ``order`` (ties in the order of a hash of
    the row), without a single-partition window."""
    return running_sums(df, group, order, [])
