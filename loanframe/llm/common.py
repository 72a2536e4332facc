"""Helpers shared by the text operators: tables, shared storage, word hashing, components."""

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanframe.session import ensure_checkpoint_dir

GOLD = np.uint64(0x9E3779B97F4A7C15)
#: ASCII white space, the bytes between words of the ``[^\x20\x09-\x0D]+`` rule.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Rows of text in one Arrow batch: a worker holds a few MB of texts, not 10,000 whole documents.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input; lowers the session's Arrow batches to ``BATCH_ROWS`` rows where they are larger."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(conf)) <= BATCH_ROWS:
        spark.conf.set(conf, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage with a table every executor can read again, so a lost
    executor costs a re-read and no recomputation.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch],
                schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b)
    return df.mapInArrow(run, schema)


def passing(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None, added: list[tuple[str, str]]):
    """For an operator that adds columns: its input, its output schema, and how it builds an output batch.

    The input has id and text first, the output id, the added columns and
    ``keep`` (which may name the text).
    """
    keep = keep or []
    src = docs.select(id_col, text_col, *(c for c in keep if c != text_col))
    at = [src.columns.index(c) for c in keep]
    new = T.DataType.fromDDL(", ".join(f"{n} {t}" for n, t in added)).fields
    out = T.StructType([src.schema[0], *new, *(src.schema[i] for i in at)])
    names = out.names

    def back(batch: pa.RecordBatch, columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, *(batch.column(i) for i in at)], names=names)

    return src, out, back


#: Bits of a membership filter (8 MB, whatever the number of keys).
FILTER_BITS = 1 << 26


def maybe_among(df: DataFrame, col: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose ``col`` may be among ``keys`` (one column): a bitmap of hashed keys is broadcast and
    looked up, so most other rows needn't be shuffled to the join that decides.  No row with a key is lost;
    with very many keys the bitmap fills and all rows pass."""
    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    k = keys.select(place(F.col(keys.columns[0])).alias("h"))
    rows = k.groupBy(F.expr("bitmap_bucket_number(h)").alias("b")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("m")).collect()
    whole = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(r["m"], dtype=np.uint8)
        at = (r["b"] - 1) * len(part)
        whole[at:at + len(part)] = part[:len(whole) - at]
    sent = df.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def among(h: pd.Series) -> pd.Series:
        at = h.to_numpy() - 1
        return pd.Series((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return df.where(among(place(F.col(col))))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; NULL becomes the empty text."""
    return [t if t is not None else b"" for t in column.cast(pa.binary()).to_pylist()]


def mix64(z: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator on a uint64 array (public domain constants)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * GOLD)
_POWER = np.cumprod(np.full(1 << 16, 0x5851F42D4C957F2D, dtype=np.uint64), dtype=np.uint64)


def word_hashes(text: bytes, separators: np.ndarray = SPACE) -> np.ndarray:
    """64-bit hash of every word of ``text``, in order (vectorised over its bytes)."""
    raw = np.frombuffer(text, dtype=np.uint8)
    inside = ~separators[raw]
    step = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    sums = np.add.reduceat(_BYTE[raw[inside]] * _POWER[at & 0xFFFF], first)
    return mix64(sums + size.astype(np.uint64) * GOLD)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words make one shingle."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    h = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        h = mix64(h * GOLD + words[i:n - width + 1 + i])
    return np.unique(h)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(u, v)``: one row (node, root) per node.

    ``root`` is the smallest node reachable.  Union-find over Spark joins:
    each round points every neighbour at the smallest neighbour (large star),
    then every node at the smallest smaller one (small star), until the set of
    edges no longer changes.  Minima are partial aggregates and the minimum's
    side of each join has one row a node, so a hub node is split by adaptive
    skew joins and never gathered.  Nothing reaches the driver but two sums.
    """
    cur = stored(edges.where("u <> v").select("u", "v").distinct(), "cc")

    def seen(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = seen(cur)
    while last[0]:
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        small = (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", "m")).distinct())
        cur = stored(small, "cc")
        now = seen(cur)
        if now == last:
            break
        last = now
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(cur.select("v", "v").distinct()))
