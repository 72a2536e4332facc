"""Exact nearest neighbours by a k-d tree of blocks (R2).

A sample gives a tree of median splits, each along the widest column; a block
is a leaf of it, and its box what its points span.  A point is first
compared with its own block, which bounds how far its neighbours can be.  A
block whose box is farther is never looked at; the others are searched in
full, so the neighbours are exact.  Boxes are sought for the points of a block
together, by their own box and the largest of their bounds, and then for each.

Blocks have about ``BLOCK`` points up to ``LEAVES`` blocks, so work grows with
the points (and beyond that with their square over ``LEAVES``).
Equal points are one point with the smallest of their keys, so a crowd of
copies is no work.  The tree comes from a bounded sample (``SAMPLE`` points) and
decides only how much is compared.  The table of boxes has at most ``LEAVES``
rows.  Blocks are sorted before the points that ask them, and a task holds one
block while those stream by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanframe.session import shared_table

#: Points a block should have, most blocks, points that the tree is made of.
BLOCK, LEAVES, SAMPLE = 256, 1 << 15, 1 << 17
#: Distances held at a time; points of a partition.
CHUNK, PART = 1 << 20, 1 << 16


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, feature by feature: the same sum in the same order for any pair, wherever it is compared."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j][:, None] - b[:, j][None, :]
        out += gap * gap
    return out


class Tree:
    """Median splits: node i sends x[column[i]] <= at[i] to node left[i], others to the next one; leaves have ``leaf`` >= 0."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.column, self.at, self.left, self.leaf = [], [], [], []
        self.leaves = 0
        nodes = [(x, leaves)]
        self._node()
        for i, (some, most) in enumerate(nodes):                  # grows by two nodes a split
            spread = some.max(axis=0) - some.min(axis=0) if most > 1 and len(some) > 1 else np.zeros(0)
            if not len(spread) or not spread.max() > 0:
                self.leaf[i], self.leaves = self.leaves, self.leaves + 1
                continue
            j = int(spread.argmax())
            v = some[:, j]
            at = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
            if at == v.max():
                at = v[v < at].max()
            self.column[i], self.at[i], self.left[i] = j, float(at), len(nodes)
            low = v <= at
            nodes += [(some[low], most // 2), (some[~low], most - most // 2)]
            nodes[i] = None
            self._node()
            self._node()
        self.column, self.at, self.left, self.leaf = (np.array(v) for v in (self.column, self.at, self.left, self.leaf))

    def _node(self) -> None:
        for values, v in ((self.column, 0), (self.at, 0.0), (self.left, 0), (self.leaf, -1)):
            values.append(v)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(rows := rows[self.leaf[node[rows]] < 0]):
            at = node[rows]
            node[rows] = self.left[at] + ~(x[rows, self.column[at]] <= self.at[at])
        return self.leaf[node]


def _points(df: DataFrame, features: str, key: str, k: int) -> DataFrame:
    """(id, x, keys): distinct points with the k smallest keys of theirs; the id is the smallest."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(features).alias("x"))
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("x").orderBy("key"))).where(F.col("r") <= k)
    return shared_table(rows.groupBy("x").agg(F.sort_array(F.collect_list("key")).alias("keys"))
                        .select(F.col("keys")[0].alias("id"), "x", "keys"), "nearest-point")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def rows_at_once(blocks: int) -> int:
    """Rows whose distances to all blocks are held together: ``CHUNK`` distances, whatever the number of blocks."""
    return max(1, CHUNK // max(1, blocks))


def _search(x: np.ndarray, y: np.ndarray, keys: pa.ListArray, k: int, limit: np.ndarray | None) -> tuple[pa.ListArray, np.ndarray]:
    """The k nearest keys (ties: smallest) of points ``y`` for every row of ``x``, no farther than its limit; and how far the
    k-th is (infinite where there are fewer)."""
    held, ends = keys.flatten().to_numpy(), np.cumsum(keys.value_lengths().to_numpy())
    dists, found, counts, far = [], [], [], np.full(len(x), np.inf)
    step = rows_at_once(len(y))
    for lo in range(0, len(x), step):
        d = squared_distances(x[lo:lo + step], y)
        most = np.partition(d, k - 1, axis=1)[:, k - 1] if len(y) > k else np.full(len(d), np.inf)
        if limit is not None:
            most = np.minimum(most, limit[lo:lo + step])
        row, at = np.nonzero(d <= most[:, None])
        each = np.diff(ends, prepend=0)[at]                        # a point's keys
        of = np.repeat(np.arange(len(at)), each)
        key = held[np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + (ends[at] - each)[of]]
        row, dist = row[of], d[row, at][of]
        order = np.lexsort((key, dist, row))
        row, dist, key = row[order], dist[order], key[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == k - 1
        far[lo + row[last]] = dist[last]
        first = rank < k
        dists.append(dist[first])
        found.append(key[first])
        counts.append(np.bincount(row[first], minlength=len(d)))
    near = pa.StructArray.from_arrays([pa.array(np.concatenate(dists)), pa.array(np.concatenate(found), pa.int64())], names=["dist", "nbr"])
    ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near), far


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of the rows with equal values one after another."""
    n = len(columns[0])
    new = np.zeros(max(n - 1, 0), dtype=bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
    return ((lo, hi) for lo, hi in zip(cuts, cuts[1:]) if hi > lo)


_NEAR = "near array<struct<dist:double,nbr:long>>"


def _in_own(k: int):
    """Rows (block, id, x, keys) sorted by block: each with the k nearest keys in its block, and how far the last one is
    (infinite where the block has fewer)."""
    def answered(block, ids, xs, keys):
        x, keys, ids = np.concatenate(xs), pa.concat_arrays(keys), pa.concat_arrays(ids)
        for lo in range(0, len(x), 4096):
            some = x[lo:lo + 4096]
            near, far = _search(some, x, keys, k, None)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), ids.slice(lo, len(some)), _lists(some), pa.array(far), near],
                                             names=["block", "id", "x", "far", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, xs, keys = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            of, x = batch.column(0).to_numpy(), _matrix(batch.column(2))
            for lo, hi in _runs(of):
                if of[lo] != block:
                    if ids:
                        yield from answered(block, ids, xs, keys)
                    block, ids, xs, keys = int(of[lo]), [], [], []
                ids.append(batch.column(1).slice(lo, hi - lo))
                xs.append(x[lo:hi])
                keys.append(batch.column(3).slice(lo, hi - lo))
        if ids:
            yield from answered(block, ids, xs, keys)
    return run


def _in_others(k: int):
    """Rows (block, asks, id, x, keys, r) sorted by block, the block's own points first: the k nearest keys in the block of
    every point that asks, no farther than its r."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, xs, keys = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            of, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            x, r = _matrix(batch.column(3)), batch.column(5).to_numpy(zero_copy_only=False)
            for lo, hi in _runs(of, asks):
                if of[lo] != block:
                    block, xs, keys = of[lo], [], []
                if not asks[lo]:
                    xs.append(x[lo:hi])
                    keys.append(batch.column(4).slice(lo, hi - lo))
                elif xs:
                    if len(xs) > 1:
                        xs, keys = [np.concatenate(xs)], [pa.concat_arrays(keys)]
                    for at in range(lo, hi, 4096):
                        end = min(at + 4096, hi)
                        near, _ = _search(x[at:end], xs[0], keys[0], k, r[at:end])
                        yield pa.RecordBatch.from_arrays([batch.column(2).slice(at, end - at), near], names=["id", "near"])
    return run


def _gaps(lo: np.ndarray, hi: np.ndarray, lows: np.ndarray, highs: np.ndarray, limit: float) -> np.ndarray:
    """Which boxes (lows, highs) are within squared distance ``limit`` of the box (lo, hi): most are out after a column or two."""
    at, total = np.arange(len(lows)), np.zeros(len(lows))
    for j in np.argsort(lo - hi, kind="stable"):                  # first the column along which the box is widest
        gap = np.maximum(np.maximum(lows[at, j] - hi[j], lo[j] - highs[at, j]), 0.0)
        total = total + gap * gap
        near = total <= limit
        at, total = at[near], total[near]
    return at


def nearest(df: DataFrame, features: str, key: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(key, nbr, dist) for the k nearest other rows of each row (squared distance; ties: smallest key), and one row
    (compared, points): pairs of distinct points whose distance was computed, and how many points there are.

    Keys are integers and differ.  With fewer than k + 1 rows all others are neighbours.
    """
    points = _points(df, features, key, k + 1)
    n = points.count()
    kind = points.schema["x"].dataType.simpleString()
    some = points if n <= SAMPLE else points.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(n)) < SAMPLE)
    sample = some.select("id", "x").toArrow().combine_chunks().sort_by("id")["x"].combine_chunks()      # about SAMPLE points
    tree = Tree(_matrix(sample), min(LEAVES, -(-n // BLOCK))) if n else None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaf_of(_matrix(b.column(1)))), *b.columns],
                                                 names=["block", "id", "x", "keys"])
    placed = points.select("id", "x", "keys").mapInArrow(place, f"block long, id long, x {kind}, keys array<long>")
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // PART))
    placed = shared_table(placed, "nearest-placed")
    first = placed.repartition(parts, "block").sortWithinPartitions("block", "id").mapInArrow(
        _in_own(k + 1), f"block long, id long, x {kind}, far double, {_NEAR}")
    first = shared_table(first, "nearest-own")

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Boxes of the blocks of a task, a row each run of rows."""
        for b in batches:
            if not b.num_rows:
                continue
            of, x = b.column(0).to_numpy(), _matrix(b.column(1))
            runs = [*_runs(of)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([of[lo] for lo, _ in runs], pa.int64()), pa.array([hi - lo for lo, hi in runs], pa.int64()),
                 *[pa.array([v(x[lo:hi], axis=0).tolist() for lo, hi in runs], pa.list_(pa.float64())) for v in (np.min, np.max)]],
                names=["block", "n", "lo", "hi"])
    boxes = first.select("block", "x").mapInArrow(span, "block long, n long, lo array<double>, hi array<double>").toArrow()
    size: dict[int, int] = {}
    low: dict[int, np.ndarray] = {}
    high: dict[int, np.ndarray] = {}
    for block, count, lo, hi in zip(*(boxes[c].to_pylist() for c in ("block", "n", "lo", "hi")), strict=True):
        size[block] = size.get(block, 0) + count
        low[block] = np.minimum(low.get(block, lo), lo)
        high[block] = np.maximum(high.get(block, hi), hi)
    numbers = np.array(sorted(size), dtype=np.int64)                                           # at most LEAVES
    lows, highs = (np.array([of[b] for b in numbers.tolist()]) for of in (low, high))

    def asked(of: int, ids: pa.Array, x: np.ndarray, far: np.ndarray) -> Iterator[pa.RecordBatch]:
        limit = far * (1 + 1e-9) + 1e-12
        boxes_at = _gaps(x.min(axis=0), x.max(axis=0), lows, highs, float(limit.max()))
        boxes_at = boxes_at[numbers[boxes_at] != of]
        step = rows_at_once(len(boxes_at))
        for lo in range(0, len(x), step):
            some = x[lo:lo + step]
            total = np.zeros((len(some), len(boxes_at)))
            for j in range(x.shape[1]):
                v = some[:, j][:, None]
                gap = np.maximum(np.maximum(lows[boxes_at, j] - v, v - highs[boxes_at, j]), 0.0)
                total += gap * gap
            row, at = np.nonzero(total <= limit[lo:lo + step, None])
            for a in range(0, len(row), 8192):
                pick = row[a:a + 8192]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[boxes_at[at[a:a + 8192]]]), ids.take(pa.array(lo + pick)), _lists(some[pick]),
                     pa.array(far[lo + pick])], names=["block", "id", "x", "r"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            of, x, far = b.column(0).to_numpy(), _matrix(b.column(2)), b.column(3).to_numpy()
            for lo, hi in _runs(of):
                yield from asked(int(of[lo]), b.column(1).slice(lo, hi - lo), x[lo:hi], far[lo:hi])
    asking = shared_table(first.select("block", "id", "x", "far").mapInArrow(ask, f"block long, id long, x {kind}, r double"),
                          "nearest-ask")
    rows = placed.select("block", F.lit(False).alias("asks"), "id", "x", "keys", F.lit(0.0).alias("r")).unionByName(
        asking.select("block", F.lit(True).alias("asks"), "id", "x", F.array().cast("array<long>").alias("keys"), "r"))
    more = rows.repartition(parts, "block").sortWithinPartitions("block", "asks", "id").mapInArrow(_in_others(k + 1), f"id long, {_NEAR}")
    near = first.select("id", "near").union(more).groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))
    near = near.select("id", F.slice(F.sort_array("near"), 1, k + 1).alias("near"))

    of_point = points.select("x", "id").join(near, "id").select("x", "near")
    mine = df.select(F.col(key).cast("long").alias("key"), F.col(features).alias("x")).join(of_point, "x")
    others = F.slice(F.filter("near", lambda v: v["nbr"] != F.col("key")), 1, k)
    out = mine.select("key", F.explode(others).alias("v")).select("key", F.col("v.nbr").alias("nbr"), F.col("v.dist").alias("dist"))
    sizes = df.sparkSession.createDataFrame([*size.items()], "block long, n long")
    work = asking.join(F.broadcast(sizes), "block").agg(
        (F.coalesce(F.sum("n"), F.lit(0)) + F.lit(sum(v * v for v in size.values()))).cast("long").alias("compared"))
    return out, work.withColumn("points", F.lit(n).cast("long"))
