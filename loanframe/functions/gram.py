"""Gram matrices by group.

Each partition turns its Arrow batches into numpy blocks and forms
X'WX, X'Wy, sums and counts per group with BLAS.  The partitions' vectors (one
per group, p(p+1)/2 + O(p) doubles) are added in two steps: ``TREE`` tasks add
a share each, the driver adds what these return.  So no task reads more than a
``TREE``-th of them, whatever the number of partitions.  Used by the ridge classifiers,
LDA and the Newton steps.

``expand`` turns a block of stored columns into the block of features, so that
features made of few columns (all their products, say) needn't be stored or shipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that add up the vectors of all partitions.
TREE = 32

Expand = Callable[[np.ndarray], np.ndarray]


def _blobs(sums: dict[str, np.ndarray], salt: int) -> Iterator[pa.RecordBatch]:
    if sums:
        yield pa.RecordBatch.from_pydict({"g": list(sums), "salt": [salt] * len(sums),
                                          "v": [np.asarray(v, dtype="<f8").tobytes() for v in sums.values()]},
                                         schema=pa.schema([("g", pa.string()), ("salt", pa.int32()), ("v", pa.binary())]))


def _added(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    acc: dict[str, np.ndarray] = {}
    for b in batches:
        for g, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            x = np.frombuffer(v, dtype="<f8")
            acc[g] = acc[g] + x if g in acc else x
    return acc


def tree_sums(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums by name of the vectors that ``work`` returns for each partition of ``df``."""
    def part(batches):
        yield from _blobs(work(batches), TaskContext.get().partitionId() % TREE)

    def add(batches):
        yield from _blobs(_added(batches), 0)

    form = "g string, salt int, v binary"
    rows = df.mapInArrow(part, form).repartition(TREE, "salt").mapInArrow(add, form)
    return _added(rows.toArrow().to_batches())


@dataclass(frozen=True)
class Interactions:
    """Columns z and their products z_i z_j (i < j, in that order), each less ``mean``, over ``scale``."""
    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, z: np.ndarray) -> np.ndarray:
        p = z.shape[1]
        out, at = np.empty((len(z), p + p * (p - 1) // 2)), p
        out[:, :p] = z
        for i in range(p - 1):
            np.multiply(z[:, i:i + 1], z[:, i + 1:], out=out[:, at:at + p - 1 - i])
            at += p - 1 - i
        out -= self.mean
        out /= self.scale
        return out

    def columns(self, z: np.ndarray) -> np.ndarray:
        """The features of a block whose rows are the columns of ``z``, a row a feature: the same numbers, made in long runs."""
        z, p = np.ascontiguousarray(z), len(z)
        out, at = np.empty((p + p * (p - 1) // 2, z.shape[1] + 8))[:, :-8], p        # rows a power of two apart share cache lines
        out[:p] = z
        for i in range(p - 1):
            np.multiply(z[i], z[i + 1:], out=out[at:at + p - 1 - i])
            at += p - 1 - i
        out -= self.mean[:, None]
        out /= self.scale[:, None]
        return out

    def width(self) -> int:
        return len(self.mean)

    def form(self, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray, float]:
        """(Q, q, c) with w . features + b = z'Qz + q'z + c; Q is upper triangular."""
        p = int((np.sqrt(8 * len(w) + 1) - 1) / 2)
        raw = w / self.scale
        q = np.zeros((p, p))
        q[np.triu_indices(p, 1)] = raw[p:]
        return q, raw[:p], float(b - raw @ self.mean)


def quadratic(base: Column, q: np.ndarray, linear: np.ndarray, constant: float) -> Column:
    """z'Qz + q'z + c of an array column."""
    rows = F.array(*[F.struct(F.lit(float(v)).alias("v"), F.array(*[F.lit(float(x)) for x in r]).alias("r"))
                     for v, r in zip(linear, q, strict=True)])
    each = F.zip_with(base, rows, lambda z, r: z * F.aggregate(
        F.zip_with(base, r["r"], lambda a, x: a * x), r["v"], lambda s, x: s + x))
    return F.aggregate(each, F.lit(float(constant)), lambda s, x: s + x)


def dot(features: Column, w: np.ndarray, constant: float) -> Column:
    """w . x + c of an array column: one expression of any width."""
    if not len(w):
        return F.lit(float(constant))
    products = F.zip_with(features, F.array(*[F.lit(float(v)) for v in w]), lambda a, x: a * x)
    return F.aggregate(products, F.lit(float(constant)), lambda s, x: s + x)


def _layout(p: int) -> int:
    # [n, sw, sy, syy, sx(p), sxy(p), upper(X'X) p(p+1)/2]
    return 4 + 2 * p + p * (p + 1) // 2


def gram_by_group(df: DataFrame, features: str, label: str | None = None, weight: str | None = None,
                  group: str | None = None, p: int | None = None, expand: Expand | None = None) -> dict:
    """Weighted sufficient statistics per group value.

    Returns ``{group_value: {"n", "sw", "sy", "syy", "sx", "sxy", "xtx"}}``
    (``None`` key when ungrouped).  ``features`` is an array<double> column;
    with ``expand`` (then ``p`` is the number of features it makes) it holds what these are made of.
    """
    if p is None:
        first = df.select(F.size(features).alias("p")).first()
        p = int(first["p"]) if first is not None else 0
    iu = np.triu_indices(p)
    cols = [features] + ([label] if label else []) + ([weight] if weight else []) + ([group] if group else [])

    def work(batches) -> dict[str, np.ndarray]:
        acc: dict[str, np.ndarray] = {}
        for batch in batches:
            b = ArrowBatch(batch)
            if b.empty:
                continue
            x = b.matrix(features)
            x = expand(x) if expand else x
            y = b[label].to_numpy(dtype=float) if label else np.zeros(len(b))
            w = b[weight].to_numpy(dtype=float) if weight else np.ones(len(b))
            keys = b[group].to_numpy() if group else np.zeros(len(b), dtype=int)
            for k in np.unique(keys):
                m = keys == k
                xk, yk, wk = x[m], y[m], w[m]
                xw = xk * wk[:, None]
                v = np.concatenate([[m.sum(), wk.sum(), (wk * yk).sum(), (wk * yk * yk).sum()],
                                    xw.sum(axis=0), xw.T @ yk, (xw.T @ xk)[iu]])
                kk = str(k.item() if hasattr(k, "item") else k)
                acc[kk] = acc[kk] + v if kk in acc else v
        return acc

    out = {}
    for name, v in tree_sums(df.select(*cols), work).items():
        xtx = np.zeros((p, p))
        xtx[iu] = v[4 + 2 * p:]
        xtx = xtx + np.triu(xtx, 1).T
        key = None if not group else name
        out[key] = {"n": v[0], "sw": v[1], "sy": v[2], "syy": v[3], "sx": v[4:4 + p],
                    "sxy": v[4 + p:4 + 2 * p], "xtx": xtx}
    return out


def centered(g: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Weighted centred cross products: (mean_x, Cxx, Cxy, Cyy, mean_y)."""
    sw = g["sw"]
    mx, my = g["sx"] / sw, g["sy"] / sw
    cxx = g["xtx"] - sw * np.outer(mx, mx)
    cxy = g["sxy"] - sw * mx * my
    cyy = g["syy"] - sw * my * my
    return mx, cxx, cxy, cyy, my


class ArrowBatch:
    """A record batch seen as columns of numpy arrays; list columns become
    2-D blocks without a per-row Python object (flatten + reshape)."""

    def __init__(self, batch):
        self.b = batch

    def __len__(self) -> int:
        return self.b.num_rows

    @property
    def empty(self) -> bool:
        return self.b.num_rows == 0

    def __getitem__(self, name: str) -> pd.Series:
        return pd.Series(self.b.column(name).to_numpy(zero_copy_only=False))

    def matrix(self, name: str) -> np.ndarray:
        col = self.b.column(name)
        n = len(col)
        if n == 0:
            return np.zeros((0, 0))
        flat = col.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
        return flat.reshape(n, -1)


def partition_sums(df: DataFrame, fn, size: int) -> np.ndarray:
    """Sum of ``fn(batch) -> vector[size]`` over all rows; ``fn`` runs per Arrow record batch (columns as
    numpy, the feature list column as one 2-D block)."""
    def work(batches) -> dict[str, np.ndarray]:
        acc = None
        for batch in batches:
            if batch.num_rows:
                v = fn(ArrowBatch(batch))
                acc = v if acc is None else acc + v
        return {} if acc is None else {"": acc}
    return tree_sums(df, work).get("", np.zeros(size))


def matrix(pdf, features: str) -> np.ndarray:
    if isinstance(pdf, ArrowBatch):
        return pdf.matrix(features)
    return np.vstack(pdf[features].to_numpy()).astype(float)
