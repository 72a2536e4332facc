"""Duplicates (D1-D4) and the profile of missing data.

Design rule: one aggregate for all columns.  Loops over columns build
expressions, never jobs.  Every grouping uses map-side partial aggregation,
so a value (or a fully identical row) that holds a third of the table is
combined inside each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a group of identical rows is re-expanded in chunks of this many copies,
# so one hot row never makes one task emit a third of the table
CHUNK = 1 << 20


def replicate_rows(df: DataFrame, n_col: str, chunk: int = CHUNK) -> DataFrame:
    """Emit each row ``n_col`` times, skew-safe.

    Rows with at most ``chunk`` copies explode in place.  The few rows with
    more are first split into chunk rows (at most total/chunk of them, so
    that shuffle is tiny), spread by a round-robin repartition, and only then
    exploded.
    """
    n = F.col(n_col)
    small = df.filter(n <= chunk).withColumn(
        "_rep", F.explode(F.sequence(F.lit(1), n))).drop("_rep")
    big = df.filter(n > chunk)
    n_chunks = ((n - 1) / F.lit(chunk)).cast("long")
    big = (big.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), n_chunks)))
           .repartition(F.col("_chunk"), *[F.col(c) for c in df.columns if c != n_col])
           .withColumn("_len", F.least(F.lit(chunk).cast("long"), n - F.col("_chunk") * chunk))
           .withColumn("_rep", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_len"))))
           .drop("_chunk", "_len", "_rep"))
    return small.unionByName(big)


def flag_duplicates(df: DataFrame) -> DataFrame:
    """Every row with ``is_duplicate`` = an equal row came earlier.

    Equal rows are equal on all columns, so which copy is "first" cannot be
    seen in the output: the result holds, per distinct row, one copy with
    false and the others with true.  Built as a partial aggregate plus a
    skew-safe re-expansion instead of a window over all columns (a window
    would put a hot group in one task).
    """
    cols = df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    first = g.drop("_n").withColumn("is_duplicate", F.lit(False))
    rest = (g.filter(F.col("_n") > 1).withColumn("_n", F.col("_n") - 1))
    rest = replicate_rows(rest, "_n").drop("_n").withColumn("is_duplicate", F.lit(True))
    return first.unionByName(rest)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """The rows ``df.duplicated()`` marks (each extra copy once)."""
    cols = df.columns
    g = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
         .filter(F.col("_n") > 1).withColumn("_n", F.col("_n") - 1))
    return replicate_rows(g, "_n").drop("_n")


def drop_duplicates(df: DataFrame) -> DataFrame:
    """D3: keep one of each set of equal rows."""
    return df.dropDuplicates()


def shape_before_after(df: DataFrame) -> DataFrame:
    """Rows before and after D3, and the column count, in one shuffle."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").cast("bigint").alias("rows_before"),
                 F.count(F.lit(1)).alias("rows_after"),
                 F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


# ----------------------------------------------------------------- profile

def _dtype_name(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def column_profile(df: DataFrame) -> DataFrame:
    """N1 (``info``) and N2/N3: per column position, type, non-null and null
    counts and null share, from one aggregate."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.col(c)).alias(f"_nn{i}") for i, c in enumerate(cols)])
    items = F.array(*[F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("column"),
                               F.lit(_dtype_name(df, c)).alias("dtype"),
                               F.col(f"_nn{i}").alias("non_null"))
                      for i, c in enumerate(cols)])
    out = row.select(F.col("_rows").alias("n_rows"), F.inline(items))
    return (out.withColumn("null_count", F.col("n_rows") - F.col("non_null"))
            .withColumn("null_share", F.when(F.col("n_rows") > 0,
                                             F.col("null_count") / F.col("n_rows"))))


def null_counts_wide(df: DataFrame) -> DataFrame:
    """Null counts as one wide row (one column per input column)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def empty_counts(df: DataFrame) -> DataFrame:
    """N4 and N5 in one aggregate: fully empty rows, fully empty columns."""
    cols = df.columns
    all_null = F.lit(True)
    for c in cols:
        all_null = all_null & F.col(c).isNull()
    row = df.agg(F.count_if(all_null).alias("empty_rows"),
                 *[F.count(F.col(c)).alias(f"_nn{i}") for i, c in enumerate(cols)])
    empty_cols = sum((F.when(F.col(f"_nn{i}") == 0, 1).otherwise(0) for i in range(len(cols))),
                     F.lit(0))
    return row.select("empty_rows", empty_cols.cast("bigint").alias("empty_columns"))


def null_flags_long(df: DataFrame, cols: list[str] | None = None,
                    key: str | None = None) -> DataFrame:
    """``isna().melt()``: one (variable, missing) row per cell."""
    cols = cols or df.columns
    ids = [key] if key else []
    flags = df.select(*ids, *[F.col(c).isNull().alias(c) for c in cols])
    return flags.unpivot(ids, cols, "variable", "missing")


def null_share_bars(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """N7 aggregated (the data of the filled bars, C6): per column, count and
    share of missing / present cells.  One aggregate, no melt of the rows."""
    cols = cols or df.columns
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    items = []
    for i, c in enumerate(cols):
        for missing in (False, True):
            n = F.col(f"_m{i}") if missing else F.col("_rows") - F.col(f"_m{i}")
            items.append(F.struct(F.lit(c).alias("variable"), F.lit(missing).alias("missing"),
                                  n.alias("count"),
                                  F.when(F.col("_rows") > 0, n / F.col("_rows")).alias("share")))
    return row.select(F.inline(F.array(*items)))


def missing_patterns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each pattern of missing values with its row count.

    Pattern columns hold 1 = observed, 0 = missing; ``n_missing`` is the
    number of missing columns in the pattern.  Partial aggregation makes
    this one cheap shuffle of at most 2^p groups.
    """
    flags = [F.when(F.col(c).isNull(), 0).otherwise(1).cast("int").alias(c) for c in cols]
    n_missing = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)).alias("n_missing")
    return (df.select(*flags, n_missing).groupBy(*cols, "n_missing")
            .agg(F.count(F.lit(1)).alias("row_count")))


def patterns_with_margins(df: DataFrame, cols: list[str]) -> DataFrame:
    """N8 with its margins: the rows of ``missing_patterns`` (``variable`` NULL), and for every column one row with
    that column 0, the others NULL and the number of rows that miss it, from the same shuffle (grouping sets)."""
    flags = df.select(*[F.when(F.col(c).isNull(), 0).otherwise(1).cast("int").alias(c) for c in cols],
                      *[F.col(c).isNull().cast("int").alias(f"_m{i}") for i, c in enumerate(cols)])
    g = flags.groupingSets([cols, []], *cols).agg(
        F.grouping_id().alias("_all"), F.count(F.lit(1)).alias("row_count"), *[F.sum(f"_m{i}").alias(f"_s{i}") for i in range(len(cols))])
    kinds = {"variable": "string", **{c: "int" for c in cols}, "n_missing": "int", "row_count": "bigint"}

    def row(*values):
        return F.struct(*[v.cast(kind).alias(name) for v, (name, kind) in zip(values, kinds.items(), strict=True)])
    none = F.lit(None)
    n_missing = sum((1 - F.col(c) for c in cols), F.lit(0))
    pattern = row(none, *[F.col(c) for c in cols], n_missing, F.col("row_count"))
    margins = [row(F.lit(c), *[F.lit(0) if x == c else none for x in cols], none, F.coalesce(F.col(f"_s{i}"), F.lit(0)))
               for i, c in enumerate(cols)]
    return g.select(F.inline(F.when(F.col("_all") == 0, F.array(pattern)).otherwise(F.array(*margins))))


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """Frequency of each value, most frequent first (ties by value)."""
    src = df.filter(F.col(col).isNotNull()) if dropna else df
    return (src.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_last(col)))


def null_heatmap(df: DataFrame, key: str, cols: list[str], n_blocks: int = 50) -> DataFrame:
    """Null share per (row block, column); rows are ordered by ``key`` and
    cut into ``n_blocks`` equal-width key ranges.  Two aggregates."""
    b = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, hi = (b["lo"], b["hi"]) if b is not None else (None, None)
    if lo is None:
        return df.sparkSession.createDataFrame([], "block bigint, variable string, null_share double")
    width = float(hi - lo + 1)
    block = F.floor((F.col(key) - F.lit(lo)) * F.lit(float(n_blocks)) / F.lit(width)).cast("bigint")
    g = df.groupBy(block.alias("block")).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    items = F.array(*[F.struct(F.lit(c).alias("variable"),
                               (F.col(f"_m{i}") / F.col("_rows")).alias("null_share"))
                      for i, c in enumerate(cols)])
    return g.select("block", F.inline(items))
