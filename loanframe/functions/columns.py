"""Projection, predicates and scalar functions.

All of these are plain column expressions: they stay in whole-stage codegen,
need no shuffle, and Catalyst pushes the filters and the column pruning down
to the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType


def select_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P1."""
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P2."""
    return df.drop(*cols)


def columns_of_kind(df: DataFrame, kind: str, exclude: Iterable[str] = ()) -> list[str]:
    """Column names by type, in schema order.

    ``numeric`` = integral and fractional (booleans are not numeric here),
    ``category`` = strings and booleans, ``flag`` = booleans.  Derived flags,
    the label and the key are passed in ``exclude``; they are never picked
    by type alone.
    """
    skip = set(exclude)
    out = []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        t = f.dataType
        if kind == "numeric" and isinstance(t, NumericType):
            out.append(f.name)
        elif kind == "category" and isinstance(t, (StringType, BooleanType)):
            out.append(f.name)
        elif kind == "flag" and isinstance(t, BooleanType):
            out.append(f.name)
    return out


def null_flags(df: DataFrame, cols: Iterable[str], suffix: str = "_missing",
               names: Mapping[str, str] | None = None) -> DataFrame:
    """One boolean null indicator per column, all in one projection."""
    names = dict(names or {})
    return df.withColumns({names.get(c, f"{c}{suffix}"): F.col(c).isNull() for c in cols})


def cast_columns(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    """P5: ``{"pel_missing": "int", "cb_person_default_on_file": "string"}``."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()})


def replace_levels(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """Merge rare levels by value replacement."""
    expr = F.col(col)
    for old, new in mapping.items():
        expr = F.when(F.col(col) == F.lit(old), F.lit(new)).otherwise(expr)
    return df.withColumn(col, F.when(F.col(col).isNull(), F.col(col)).otherwise(expr))


def outside(col: Column | str, lo: float, hi: float) -> Column:
    """The OR of two range tests (NULL is never outside)."""
    c = F.col(col) if isinstance(col, str) else col
    return (c < F.lit(lo)) | (c > F.lit(hi))


def concat_levels(a: str, b: str, sep: str = "_", null_text: str | None = None) -> Column:
    """``a + "_" + b`` of two category columns.  A NULL side gives NULL
    unless ``null_text`` names the text to use for it."""
    ca, cb = F.col(a).cast("string"), F.col(b).cast("string")
    if null_text is not None:
        ca, cb = F.coalesce(ca, F.lit(null_text)), F.coalesce(cb, F.lit(null_text))
    return F.concat(ca, F.lit(sep), cb)


def fill_text(col: str, text: str = "NONE") -> Column:
    """NULL to a constant level (cast first: ANSI mode refuses mixed types)."""
    return F.coalesce(F.col(col).cast("string"), F.lit(text))


def log1p(col: str) -> Column:
    """P10: natural log of 1 + x (NULL for x <= -1)."""
    return F.when(F.col(col) > -1, F.log1p(F.col(col)))


def append_columns(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    """Derived columns stay in the same row: no join, no index."""
    return df.withColumns(dict(cols))


def head(df: DataFrame, n: int, order: Iterable[str]) -> DataFrame:
    """The first n rows of a defined order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def top_k(df: DataFrame, score: str, k: int, tie: Iterable[str] = ()) -> DataFrame:
    """Top k by a score, NULL scores last."""
    return df.orderBy(F.desc_nulls_last(score), *tie).limit(k)
