"""Sources and sinks.

S1 reads CSV (header; a given schema, or types inferred from all rows with
malformed rows set apart) or Parquet, and turns double NaN into NULL at the source (Spark reads the text
``NaN`` as a NaN, and ``NaN > 3`` is true).  S2 writes without an index
column; an array of features is expanded to named columns for CSV.  S3
saves / loads fitted pipelines with Spark ML persistence.  S4 joins labels
back on the key.  Paths are whatever the caller gives: on a cluster a
shared folder, never a machine-local one.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType


def nan_to_null(df: DataFrame) -> DataFrame:
    fix = {f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType))
           for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.withColumns(fix) if fix else df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: StructType | str | None = None, header: bool = True) -> DataFrame:
    """S1."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        if schema is None:
            return read_csv(spark, path, header)
        df = r.option("header", header).csv(path)
    else:
        df = r.format(fmt).load(path)
    return nan_to_null(df)


def read_csv(spark: SparkSession, path: str, header: bool = True, bad_col: str = "malformed") -> DataFrame:
    """S1 for CSV without a schema: column types inferred from all rows of all files.

    ``bad_col`` holds the text of a row that has another number of fields than the
    columns, or a value that isn't of its column's type; its other columns are
    NULL, so that nothing of it counts.  Rows that parse have NULL there.
    """
    whole = spark.read.option("header", header).option("inferSchema", True).option("samplingRatio", 1.0)
    schema = whole.csv(path).schema
    rows = (spark.read.schema(StructType([*schema.fields, StructField(bad_col, StringType())])).option("header", header)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad_col).csv(path))
    good = F.col(f"`{bad_col}`").isNull()
    return nan_to_null(rows.select(*[F.when(good, F.col(f"`{c}`")).alias(c) for c in schema.names], f"`{bad_col}`"))


def malformed_count(df: DataFrame, bad_col: str = "malformed") -> DataFrame:
    """(rows, malformed): how many rows a CSV read gave, and how many of them didn't parse."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(bad_col).isNotNull()).alias("malformed"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a table (no index column exists to drop)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def save_pipeline(model: PipelineModel, path: str) -> None:
    """S3: save a *fitted* pipeline."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def join_labels(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Labels stored apart come back by key, never by position."""
    return features.join(labels, on=key, how="inner")
