"""Sums over linear models' rows, cell by cell.

A row of base columns is a few numbers and many 0/1 columns.  Rows with the same 0/1 columns are a cell, and inside
a cell every feature (a column, or a product of two) is a fixed linear function of the numbers, their products and 1:
the cell's terms.  So a pass sums gradients and Hessians of many models over the few terms of each cell, one matrix
product a block, and puts them where they belong among the features at a cell's end.  The sums are those over the
features; the features are never made.

Rows are (bits, n, ...): the packed 0/1 columns and the numbers.  They are stored once, dealt to ranges of ``bits`` so that
a partition has few cells, as blocks: a stored row is up to ``BLOCK`` rows of one cell, its numbers and its other columns
as bytes.  Unsorted rows or many cells cost time, not correctness.  Numbers are held less their mean over their spread, and
``change`` turns sums over the terms into sums over the features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanframe.functions.gram import TREE, ArrowBatch, Interactions, _added, _blobs, tree_sums
from loanframe.session import shared_table

#: Rows worked on at a time; most terms whose products are formed once for all models.
BLOCK, PAIRED = 2048, 40
#: Models from which such products are formed once.
MANY = 8
#: Rows of a stored partition, and cells whose places a task remembers.
PART, SEEN = 1 << 18, 4096


@dataclass(frozen=True)
class Cells:
    """How base columns (``numbers`` and 0/1 ``flags``) make the features: themselves (``made`` None) or with products."""
    numbers: np.ndarray
    flags: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    made: Interactions | None = None
    seen: dict = field(default_factory=dict, compare=False, repr=False)

    def columns(self) -> int:
        return len(self.numbers) + len(self.flags)

    def width(self) -> int:
        """Features and the intercept."""
        p = self.columns()
        return 1 + (p * (p + 1) // 2 if self.made else p)

    def terms(self, n: np.ndarray) -> np.ndarray:
        """1, the numbers and, where features are products, their products."""
        one = np.ones((len(n), 1))
        if not self.made:
            return np.hstack([one, n])
        i, j = np.triu_indices(n.shape[1], 1)
        return np.hstack([one, n, n[:, i] * n[:, j]])

    def places(self, bits: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of a cell: which of (1, columns, products) aren't zero, and the term each of these equals."""
        if bits not in self.seen:
            if len(self.seen) >= SEEN:
                self.seen.clear()
            self.seen[bits] = self._places(bits)
        return self.seen[bits]

    def _places(self, bits: bytes) -> tuple[np.ndarray, np.ndarray]:
        p, k = self.columns(), len(self.numbers)
        code = np.full(p, -1)
        code[self.flags] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(self.flags)).astype(int) - 1
        code[self.numbers] = 1 + np.arange(k)
        all_codes = [np.zeros(1, dtype=int), code]
        if self.made:
            i, j = np.triu_indices(p, 1)
            a, b = code[i], code[j]
            lo, hi = np.minimum(a, b) - 1, np.maximum(a, b) - 1
            pair = 1 + k + lo * k - lo * (lo + 1) // 2 + hi - lo - 1
            all_codes.append(np.where((a < 0) | (b < 0), -1, np.where(a == 0, b, np.where(b == 0, a, pair))))
        codes = np.concatenate(all_codes)
        at = np.flatnonzero(codes >= 0)
        return at, codes[at]

    def change(self) -> np.ndarray:
        """M with (features, 1) = M (1, columns, products), the columns and products on the right being of held numbers."""
        p, q = self.columns(), self.width()
        s, m = np.ones(p), np.zeros(p)
        s[self.numbers], m[self.numbers] = self.scale, self.mean
        out = np.zeros((q, q))
        r = np.arange(p)
        out[r, 1 + r], out[r, 0] = s, m
        if self.made:
            i, j = np.triu_indices(p, 1)
            r = p + np.arange(len(i))
            out[r, 1 + r], out[r, 1 + j], out[r, 1 + i], out[r, 0] = s[i] * s[j], m[i] * s[j], s[i] * m[j], m[i] * m[j]
            out[:-1, 0] -= self.made.mean
            out[:-1] /= self.made.scale[:, None]
        out[-1, 0] = 1.0
        return out


@dataclass(frozen=True)
class CellRows:
    """Stored rows (bits, n, ...) and how they make the features."""
    df: DataFrame
    cells: Cells
    parts: int | None = None        # partitions, where known
    count: int = 0                  # rows
    packed: bool = False            # a row of ``df`` is a block

    def table(self, columns: list[str]) -> DataFrame:
        """What ``blocks`` takes for these columns."""
        return self.df if self.packed else self.df.select("bits", "n", *columns)

    def of(self, df: DataFrame) -> CellRows:
        """The rows with other columns beside them."""
        return CellRows(df, self.cells, count=self.count)


def cell_rows(df: DataFrame, features: str, keep: list[str], made: Interactions | None = None) -> CellRows:
    """``df``'s rows as cells of the array column ``features``, with the columns ``keep``."""
    def seen(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        acc = None
        for batch in batches:
            if batch.num_rows:
                x = ArrowBatch(batch).matrix(features)
                v = np.stack([np.full(x.shape[1], float(len(x))), ((x == 0) | (x == 1)).sum(axis=0), x.sum(axis=0)])
                acc = v if acc is None else acc + v
        return {} if acc is None else {"": acc.ravel()}

    got = tree_sums(df.select(features), seen).get("")
    if got is None:
        p = int((np.sqrt(8 * made.width() + 1) - 1) / 2) if made else 0
        got = np.zeros(3 * p)
    n, binary, total = got.reshape(3, -1)
    numbers, flags = np.flatnonzero(binary < n), np.flatnonzero(binary >= n)
    mean = total[numbers] / n[numbers]

    def spread(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        acc = np.zeros(len(numbers))
        for batch in batches:
            if batch.num_rows:
                acc += ((ArrowBatch(batch).matrix(features)[:, numbers] - mean) ** 2).sum(axis=0)
        return {"": acc}

    sd = np.sqrt(tree_sums(df.select(features), spread).get("", np.zeros(len(numbers))) / np.maximum(n[numbers], 1))
    cells = Cells(numbers, flags, mean, np.where(sd > 0, sd, 1.0), made)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = ArrowBatch(batch).matrix(features)
            bits = np.packbits(x[:, cells.flags] == 1, axis=1)
            held = (x[:, cells.numbers] - cells.mean) / cells.scale
            size = held.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in bits], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * size, pa.int32()), pa.array(held.ravel())),
                 *batch.columns[1:]], names=["bits", "n", *keep])

    form = ", ".join(["bits binary", "n array<double>", *[f"`{c}` {t}" for c, t in df.select(*keep).dtypes]])
    return CellRows(df.select(features, *keep).mapInArrow(packed, form), cells, count=int(n[0]) if len(n) else 0)


def stored(rows: CellRows) -> CellRows:
    """The rows written once as blocks of one cell, dealt to ranges of cells."""
    parts = max(rows.df.sparkSession.sparkContext.defaultParallelism, -(-rows.count // PART))
    # a cell of many rows is in several ranges
    dealt = rows.df.withColumn("_tie", F.xxhash64(*rows.df.columns)).repartitionByRange(parts, "bits", "_tie")
    keep = rows.df.columns[2:]
    d = dealt.sortWithinPartitions("bits").drop("_tie").mapInArrow(lambda batches: _packed(batches, keep), "bits binary, n binary, rest binary")
    df = shared_table(d, "cell-rows")
    return CellRows(df, rows.cells, df.rdd.getNumPartitions(), rows.count, True)


def _packed(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks, whatever the batches."""
    held: list[tuple[np.ndarray, pa.RecordBatch]] = []
    size, at = 0, None

    def block() -> pa.RecordBatch:
        rest = pa.Table.from_batches([b for _, b in held]).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as w:
            w.write_table(rest)
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (
            at, np.concatenate([n for n, _ in held]).astype("<f8").tobytes(), sink.getvalue().to_pybytes())], names=["bits", "n", "rest"])

    for bits, n, b in blocks(batches, keep):
        while len(n):
            if held and (bits != at or size == BLOCK):
                yield block()
                held, size = [], 0
            at, take = bits, min(BLOCK - size, len(n))
            held.append((n[:take], b.slice(0, take).select(keep)))
            size += take
            n, b = n[take:], b.slice(take)
    if held:
        yield block()


def _unpacked(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[bytes, np.ndarray, pa.RecordBatch]]:
    for bits, n, rest in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
        of = pa.ipc.open_stream(rest.as_buffer()).read_next_batch()
        empty = pa.nulls(of.num_rows)
        yield (bits.as_py(), np.frombuffer(n.as_buffer(), "<f8").reshape(of.num_rows, -1),
               pa.RecordBatch.from_arrays([empty, empty, *[of.column(c) for c in columns]], names=["bits", "n", *columns]))


def blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[bytes, np.ndarray, pa.RecordBatch]]:
    """(bits, held numbers, rows) of at most ``BLOCK`` rows of one cell from the batches of ``CellRows.table(columns)``;
    the rows have ``columns`` from the third on."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if pa.types.is_binary(batch.schema.field(1).type):
            yield from _unpacked(batch, columns)
            continue
        coded = batch.column(0).dictionary_encode()
        code = coded.indices.to_numpy()
        if (np.diff(code) < 0).any():
            order = np.argsort(code, kind="stable")
            batch, code = batch.take(pa.array(order)), code[order]
        n = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
        for lo, hi in zip(cuts, cuts[1:]):
            bits = coded.dictionary[int(code[lo])].as_py()
            for at in range(lo, hi, BLOCK):
                end = min(at + BLOCK, hi)
                yield bits, n[at:end], batch.slice(at, end - at)


def coefficients(cells: Cells, bits: bytes, gamma: np.ndarray) -> np.ndarray:
    """Coefficients of a cell's terms for models whose coefficients of (1, columns, products) are ``gamma``'s columns."""
    at, term = cells.places(bits)
    k = len(cells.numbers)
    out = np.zeros((1 + k + (k * (k - 1) // 2 if cells.made else 0), gamma.shape[1]))
    np.add.at(out, term, gamma[at])
    return out


class Sums:
    """Gradients and Hessians (packed upper triangles) over (1, columns, products) of ``count`` models."""

    def __init__(self, cells: Cells, count: int, hessian: bool):
        q = cells.width()
        self.cells, self.count, self.hessian = cells, count, hessian
        self.g = np.zeros((q, count))
        self.h = np.zeros((q * (q + 1) // 2 if hessian else 0, count))
        self.bits: bytes | None = None
        self.cg = self.ch = None

    def add(self, bits: bytes, terms: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> None:
        """Rows of a cell: gradient ``terms' slope``, Hessian ``terms' diag(curve_m) terms`` of every model m."""
        t = terms.shape[1]
        if bits != self.bits:
            self.flush()
            self.bits, self.cg = bits, np.zeros((t, self.count))
            self.ch = np.zeros((t * (t + 1) // 2 if self.hessian else 0, self.count))
        self.cg += terms.T @ slope
        if not self.hessian:
            return
        i, j = np.triu_indices(t)
        if t <= PAIRED and self.count > MANY:
            self.ch += (terms[:, i] * terms[:, j]).T @ curve
        else:
            for m in range(self.count):
                self.ch[:, m] += ((terms * curve[:, m:m + 1]).T @ terms)[i, j]

    def flush(self) -> None:
        if self.bits is None:
            return
        at, term = self.cells.places(self.bits)
        self.g[at] += self.cg[term]
        if self.hessian:
            t, q = len(self.cg), self.cells.width()
            a, b = np.triu_indices(len(at))
            lo, hi = np.minimum(term[a], term[b]), np.maximum(term[a], term[b])
            i, j = at[a], at[b]
            self.h[i * q - i * (i - 1) // 2 + j - i] += self.ch[lo * t - lo * (lo - 1) // 2 + hi - lo]
        self.bits = None

    def vectors(self, first: np.ndarray) -> dict[str, np.ndarray]:
        """``first[m]``, gradient and Hessian of each model, by its number."""
        self.flush()
        return {str(m): np.concatenate([first[m], self.g[:, m], self.h[:, m]]) for m in range(self.count)}


def unpacked(cells: Cells, change: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the features from sums over (1, columns, products)."""
    q = cells.width()
    if not len(h):
        return change @ g, np.zeros((0, 0))
    full = np.zeros((q, q))
    full[np.triu_indices(q)] = h
    full = full + np.triu(full, 1).T
    return change @ g, change @ full @ change.T


def summed(rows: CellRows, columns: list[str], count: int, work: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]],
           finish: Callable[[str, np.ndarray], np.ndarray]) -> dict[str, np.ndarray]:
    """``finish(name, sum)`` of the vectors that ``work`` returns for each partition, by name (``count`` names); each
    name's work is done in one task.  With more than ``TREE`` partitions their vectors are first added by ``TREE`` tasks."""
    form = "g string, salt int, v binary"

    def part(batches):
        yield from _blobs(work(batches), TaskContext.get().partitionId() % TREE)

    def add(batches):
        acc: dict[tuple, np.ndarray] = {}
        for b in batches:
            for g, s, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(v, dtype="<f8")
                acc[g, s] = acc[g, s] + x if (g, s) in acc else x
        for (g, s), v in acc.items():
            yield from _blobs({g: v}, s)

    def end(batches):
        for g, v in _added(batches).items():
            yield from _blobs({g: finish(g, v)}, 0)

    sums = rows.table(columns).mapInArrow(part, form)
    if rows.parts is None or rows.parts > TREE:
        sums = sums.repartition(min(TREE, count * 8), "g", "salt").mapInArrow(add, form)
    got = sums.repartition(min(TREE, count), "g").mapInArrow(end, form)
    return _added(got.toArrow().to_batches())


def grams(df: DataFrame, features: str, label: str, made: Interactions | None = None) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Rows, sums and cross products of the features by class 0 and 1, from the rows as they are."""
    rows = cell_rows(df, features, [label], made)
    cells, change = rows.cells, rows.cells.change()

    def work(batches):
        sums, count = Sums(cells, 2, True), np.zeros((2, 1))
        for bits, n, b in blocks(batches, [label]):
            y = b.column(2).to_numpy(zero_copy_only=False).astype(float)
            of = np.stack([y == 0, y == 1], axis=1).astype(float)
            count[:, 0] += of.sum(axis=0)
            sums.add(bits, cells.terms(n), of, of)
        return sums.vectors(count)

    def finish(_, v):
        q = cells.width()
        g, h = unpacked(cells, change, v[1:1 + q], v[1 + q:])
        return np.concatenate([v[:1], g[:-1], h[:-1, :-1].ravel()])

    p = cells.width() - 1
    got = summed(rows, [label], 2, work, finish)
    return {int(m): (float(v[0]), v[1:1 + p], v[1 + p:].reshape(p, p)) for m, v in got.items()}
