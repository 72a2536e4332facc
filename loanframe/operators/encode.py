"""Encodings and group features (E1-E10) and most-frequent imputation.

Levels of all category columns come from one job: the (column, level)
pairs are counted with partial aggregation.  Up to ``max_levels`` of a column are a
list in the fitted model, and its transforms are column expressions.  More are
a table of levels and codes (``code_table``), written once and joined: no
list of them reaches the driver.  Dummies of such a column can't be a column each:
``SparseOneHotEncoder`` puts the dummies of all columns into one sparse vector, for any number of levels.
"""

from __future__ import annotations

import uuid

from pyspark.ml.feature import OneHotEncoder as MLOneHot
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanframe.functions.ordering import global_rank
from loanframe.operators.base import FitEstimator, FittedModel
from loanframe.session import ensure_checkpoint_dir

MAX_LEVELS = 10_000
# size bound under which a group-count table is broadcast
BROADCAST_ROWS = 1_000_000


class TooManyLevels(ValueError):
    pass


def level_counts(df: DataFrame, cols: list[str], max_levels: int = MAX_LEVELS,
                 dropna: bool = True) -> dict[str, list[tuple[str, int]]]:
    """Count of every level of every column, sorted by level.

    One shuffle of (column, level) pairs after map-side combine; a window
    keeps the ``max_levels + 1`` first levels per column so the collect is
    bounded whatever the data.
    """
    if not cols:
        return {}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"))
        for c in cols])).alias("p")).select("p.*")
    if dropna:
        pairs = pairs.filter(F.col("level").isNotNull())
    counts = pairs.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        # size check first (one small aggregate), so an unbounded level list
        # is refused before anything is sorted or collected
        sizes = {r["column"]: r["k"] for r in counts.groupBy("column").agg(
            F.count(F.lit(1)).alias("k")).collect()}
        over = [c for c, k in sizes.items() if k > max_levels]
        if over:
            raise TooManyLevels(f"column(s) {over} have more than {max_levels} levels")
        rows = counts.collect()  # at most len(cols) * max_levels rows
    finally:
        counts.unpersist()
    out: dict[str, list[tuple[str, int]]] = {c: [] for c in cols}
    for r in rows:
        out[r["column"]].append((r["level"], r["n"]))
    for lv in out.values():
        lv.sort(key=lambda t: (t[0] is not None, t[0]))
    return out


def _pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, level) of every value that isn't NULL."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level"))
        for c in cols])).alias("p")).select("p.*").filter(F.col("level").isNotNull())


def level_sizes(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Number of levels of each column (one row a column reaches the driver)."""
    if not cols:
        return {}
    found = {r["column"]: r["k"] for r in _pairs(df, cols).distinct().groupBy("column").agg(F.count("*").alias("k")).collect()}
    return {c: found.get(c, 0) for c in cols}


def sorted_levels(df: DataFrame, cols: list[str], max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """The sorted level list of each category column (NULL left out)."""
    return {c: [lv for lv, _ in v] for c, v in level_counts(df, cols, max_levels).items()}


def levels_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """E9 as a DataFrame: column, level_index, level (distributed, no collect)."""
    pairs = _pairs(df, cols).distinct()
    # levels are distinct per column; rank them with the bucketed primitive
    # (a window by column alone would put a whole column in one task)
    return _rank_strings(pairs)


def _code_expr(c: str, levels: list[str], unknown: str = "error") -> Column:
    x = F.col(c).cast("string")
    if not levels:
        return F.lit(None).cast("double")
    m = F.create_map(*[v for i, lv in enumerate(levels) for v in (F.lit(lv), F.lit(float(i)))])
    code = m[x]  # map lookup: a missing key gives NULL, not an error
    if unknown == "error":
        code = F.when(x.isNull(), F.lit(None).cast("double")).when(
            code.isNull(), F.raise_error(F.concat(F.lit(f"unknown level in {c}: "), x))
        ).otherwise(code)
    return code.cast("double")


# --------------------------------------------------------------- E1 / E6

def code_table(df: DataFrame, cols: list[str]) -> str:
    """Folder of the table (column, level_index, level) of all levels, written to the shared folder."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/levels-{uuid.uuid4().hex}"
    levels_table(df, cols).write.parquet(path)
    return path


def join_codes(df: DataFrame, table: DataFrame, col: str, out: str, unknown: str = "error") -> DataFrame:
    """``df`` with the code of ``col`` as ``out`` (double).  NULL has none; an unknown level is an error, or has none.

    Spark broadcasts the table where it is small; else rows are joined by level, and of a level that
    a large share of the rows has, the rows are split (skew join).
    """
    codes = table.where(F.col("column") == col).select(F.col("level").alias("_level"), F.col("level_index").cast("double").alias("_code"))
    x = F.col(f"`{col}`").cast("string")
    rest = [F.col(f"`{c}`") for c in df.columns if c != out]
    joined = df.withColumn("_value", x).join(codes, F.col("_value") == F.col("_level"), "left")
    code = F.col("_code")
    if unknown == "error":
        code = F.when(F.col("_value").isNotNull() & code.isNull(),
                      F.raise_error(F.concat(F.lit(f"unknown level in {col}: "), "_value")).cast("double")).otherwise(code)
    return joined.select(*rest, code.alias(out)).select(*df.columns, *([out] if out not in df.columns else []))


class OrdinalEncoderModel(FittedModel):
    def apply(self, df, state):
        out = df.withColumns({c: _code_expr(c, state["levels"][c], "error")
                              for c in self.input_cols() if c in state["levels"]})
        many = [c for c in self.input_cols() if c not in state["levels"]]
        if many:
            table = df.sparkSession.read.parquet(state["table"])
            for c in many:
                out = join_codes(out, table, c, c)
        return out


class OrdinalEncoder(FitEstimator):
    """E1 (label encoding) and E6 (ordinal by a given order).

    ``categories`` fixes the order per column; otherwise levels are sorted.
    Unknown levels raise an error, NULL stays NULL.  Columns of more than
    ``max_levels`` levels are encoded by a join with their code table, which is in the
    shared folder and has to stay there as long as the model is used.
    """
    model_class = OrdinalEncoderModel

    def __init__(self, inputCols=None, categories: dict | None = None, max_levels: int = MAX_LEVELS):
        super().__init__(inputCols, categories=categories or {}, max_levels=max_levels)

    def fit_state(self, df, cols, opts):
        given = opts.get("categories") or {}
        need = [c for c in cols if c not in given]
        most = opts.get("max_levels", MAX_LEVELS)
        sizes = level_sizes(df, need)
        few = [c for c in need if sizes[c] <= most]
        many = [c for c in need if sizes[c] > most]
        lv = sorted_levels(df, few, most) if few else {}
        lv.update({c: list(map(str, v)) for c, v in given.items()})
        return {"levels": lv, **({"table": code_table(df, many)} if many else {})}


# ------------------------------------------------------------ E2-E5

def _onehot_names(c: str, levels: list[str], drop: str | None) -> list[tuple[str, str]]:
    if drop == "first" or (drop == "if_binary" and len(levels) == 2):
        levels = levels[1:]
    return [(f"{c}_{lv}", lv) for lv in levels]


class OneHotEncoderModel(FittedModel):
    def output_cols(self):
        st = self.fitted()
        others = [c for c in self.opts().get("passthrough", [])]
        return others + [n for c in self.input_cols() for n, _ in st["names"][c]]

    def apply(self, df, state):
        new = {}
        for c in self.input_cols():
            x = F.col(c).cast("string")
            for name, lv in state["names"][c]:
                new[name] = F.when(x == F.lit(lv), F.lit(self.opts().get("one", 1.0))).otherwise(
                    F.lit(self.opts().get("zero", 0.0)))
        kept = [F.col(f"`{c}`") for c in df.columns if c not in set(self.input_cols())]
        return df.select(*kept, *[e.alias(n) for n, e in new.items()])


class OneHotEncoder(FitEstimator):
    """One 0/1 column per level, names ``col_level``.

    ``drop``: None (E4), "if_binary" (E3), "first" (E5).  Unknown levels and
    NULL give all zeros (handle_unknown='ignore').  Input columns are
    replaced by their dummies.
    """
    model_class = OneHotEncoderModel

    def __init__(self, inputCols=None, drop: str | None = None, max_levels: int = MAX_LEVELS,
                 one: float = 1.0, zero: float = 0.0):
        super().__init__(inputCols, drop=drop, max_levels=max_levels, one=one, zero=zero)

    def fit_state(self, df, cols, opts):
        lv = sorted_levels(df, cols, opts.get("max_levels", MAX_LEVELS))
        return {"levels": lv, "names": {c: _onehot_names(c, lv[c], opts.get("drop")) for c in cols}}


class SparseOneHotEncoderModel(FittedModel):
    def apply(self, df, state):
        out, drop = df, self.opts().get("drop")
        table = df.sparkSession.read.parquet(state["table"])
        parts = []
        for i, (c, n) in enumerate(state["sizes"].items()):
            out = join_codes(out, table, c, f"_code{i}", "none")
            code = F.col(f"_code{i}")
            first = 1 if n and (drop == "first" or (drop == "if_binary" and n == 2)) else 0
            # NULL, unknown and dropped levels share the last category, which has no dummy
            code = F.when(code.isNull() | (code < first), F.lit(float(n - first))).otherwise(code - first)
            if n - first:
                meta = {"ml_attr": {"type": "nominal", "name": c, "num_vals": n - first + 1}}
                out = out.withColumn(f"_code{i}", F.col(f"_code{i}")).withColumn(f"_code{i}", code.alias(f"_code{i}", metadata=meta))
                parts.append(f"_code{i}")
        if parts:
            hot = MLOneHot(inputCols=parts, outputCols=[f"{p}_hot" for p in parts], dropLast=True)
            out = VectorAssembler(inputCols=[f"{p}_hot" for p in parts], outputCol=self.opts()["output_col"]).transform(hot.fit(out).transform(out))
        return out.select(*[F.col(f"`{c}`") for c in df.columns], *([self.opts()["output_col"]] if parts else []))


class SparseOneHotEncoder(FitEstimator):
    """E3 / E4 / E5 for any number of levels: the dummies of all columns, in the order of ``inputCols`` and of their
    sorted levels, as one sparse vector ``output_col``.

    ``drop`` as in ``OneHotEncoder``; NULL and unknown levels have no 1.  The
    code table stays in the shared folder, which the fitted model reads from.
    """
    model_class = SparseOneHotEncoderModel

    def __init__(self, inputCols=None, drop: str | None = None, output_col: str = "onehot"):
        super().__init__(inputCols, drop=drop, output_col=output_col)

    def fit_state(self, df, cols, opts):
        return {"sizes": level_sizes(df, cols), "table": code_table(df, cols)}


def get_dummies(df: DataFrame, cols: list[str], drop_first: bool = True) -> DataFrame:
    """``pd.get_dummies(df, drop_first=True)`` on the given category
    columns: integer 0/1 dummies, first sorted level dropped."""
    model = OneHotEncoder(cols, drop="first" if drop_first else None).fit(df)
    st = model.fitted()
    new = {name: F.when(F.col(c).cast("string") == F.lit(lv), 1).otherwise(0)
           for c in cols for name, lv in st["names"][c]}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in set(cols)]
    return df.select(*kept, *[e.alias(n) for n, e in new.items()])


# ------------------------------------------------------------------ E7 / E8

def _join_counts(df: DataFrame, counts: DataFrame, on: str, max_broadcast_rows: int) -> DataFrame:
    # size check before broadcasting: the count table has one row per group
    n = counts.count()
    side = F.broadcast(counts) if n <= max_broadcast_rows else counts
    return df.join(side, on=on, how="left")


def group_count(df: DataFrame, by: str, of: str, name: str | None = None,
                max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``groupby(by)[of].transform('count')``: per row, the non-null count
    of ``of`` in its ``by`` group.  Pre-aggregated (map-side combine, so a
    hot group costs nothing extra), then joined back: broadcast when the
    group table is proven small, else a shuffle join that AQE splits if one
    group is skewed.  Rows with a NULL group get NULL."""
    name = name or f"{of}_count_by_{by}"
    counts = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(of).alias(name))
    return _join_counts(df, counts, by, max_broadcast_rows)


def frequency_feature(df: DataFrame, col: str, name: str | None = None, fill: str = "NONE",
                      max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Frequency of each value (NULL as the level ``NONE``) as a feature."""
    name = name or f"{col}_frequency"
    lvl = f"_{col}_level"
    d = df.withColumn(lvl, F.coalesce(F.col(col).cast("string"), F.lit(fill)))
    counts = d.groupBy(lvl).agg(F.count(F.lit(1)).alias(name))
    return _join_counts(d, counts, lvl, max_broadcast_rows)


# ------------------------------------------------------------------ I1

class MostFrequentImputerModel(FittedModel):
    def apply(self, df, state):
        out = {}
        for c in self.input_cols():
            v = state["fill"].get(c)
            if v is not None:
                out[c] = F.coalesce(F.col(c).cast("string"), F.lit(v))
        return df.withColumns(out)


class MostFrequentImputer(FitEstimator):
    """Fill NULLs with the most frequent level (lowest level on ties).
    Category columns come out as strings."""
    model_class = MostFrequentImputerModel

    def fit_state(self, df, cols, opts):
        found = {r["column"]: r["mode"] for r in most_frequent(df, cols).collect()}      # one row a column
        return {"fill": {c: found.get(c) for c in cols}}


def most_frequent(df: DataFrame, cols: list[str]) -> DataFrame:
    """I1 fitted values as a DataFrame (column, mode, count), distributed:
    level counts with map-side combine, then the top level per column
    (ties: lowest level) by a window over the small count table."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"))
        for c in cols])).alias("p")).select("p.*").filter(F.col("level").isNotNull())
    counts = pairs.groupBy("column", "level").agg(F.count(F.lit(1)).alias("count"))
    # top count per column, then the lowest level holding it: two partial
    # aggregates and a join with a one-row-per-column table (broadcast)
    top = counts.groupBy("column").agg(F.max("count").alias("count"))
    best = counts.join(F.broadcast(top), ["column", "count"])
    return best.groupBy("column").agg(F.min("level").alias("mode"), F.first("count").alias("count"))


def feature_names_table(spark, names: list[str]) -> DataFrame:
    """The ordered output feature names as (position, name)."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "position bigint, name string")


def _rank_strings(pairs: DataFrame) -> DataFrame:
    """0-based rank of each distinct (column, level) by level, per column."""
    return global_rank(pairs, "level", group="column").select(
        "column", "level", (F.col("rank") - 1).alias("level_index"))
