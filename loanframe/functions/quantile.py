"""Exact quantiles of many columns at any size.

A pass over the data summarises each column: sorted points with weights, such
that for every value v the rows up to v number between ``cum(v)``, the weight
of the points up to v, and ``cum(v) + err``.  Summaries merge by adding both;
one with too many points is thinned, and what that may hide goes into ``err``.
Tasks thin their own rows, a few merging tasks add the summaries up, and the
driver adds the last few.  Summaries of like size are merged first, so thinning
costs no more than a step for each doubling of the rows.

The bounds put every wanted rank between two points.  Where nothing was
thinned the upper one is the answer.  Else the next pass counts the rows up to
the lower one and summarises only what lies between, thousands of times
finer.  A column of few values takes one pass, millions of rows two, billions
three, for any number of ranks and columns together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points a column's summary may have (shared by the intervals still open), and rows gathered before they are summarised.
POINTS, BUFFER = 16_384, 65_536
#: Points that each open interval of a column has at least.
LEAST = 1024
#: Tasks that add up the summaries of all others.
MERGERS = 16

#: Open from below (None) or above a value, up to and including another.
Interval = tuple[float | None, float]

_ROW = "merger int, c int, part int, below long, err long, x binary, w binary"


@dataclass
class Summary:
    """Sorted distinct points, their weights, and how many rows up to a value the weights may leave out."""
    x: np.ndarray
    w: np.ndarray
    err: int = 0

    @staticmethod
    def of(values: np.ndarray) -> Summary:
        return Summary(*np.unique(values, return_counts=True))

    def merged(self, other: Summary) -> Summary:
        x, at = np.unique(np.concatenate([self.x, other.x]), return_inverse=True)
        w = np.zeros(len(x), dtype=np.int64)
        np.add.at(w, at, np.concatenate([self.w, other.w]))
        return Summary(x, w, self.err + other.err)

    def thinned(self, points: int) -> Summary:
        """At most about ``points`` points: runs of points become their last one.  A heavy point stays alone."""
        if len(self.x) <= 2 * points:
            return self
        cum = np.cumsum(self.w)
        block = (cum - 1) * points // int(cum[-1])
        ends = np.flatnonzero(np.concatenate([block[1:] != block[:-1], [True]]))
        starts = np.concatenate([[0], ends[:-1] + 1])
        hidden = np.concatenate([[0], cum])[ends] - np.concatenate([[0], cum])[starts]     # a block's rows before its last point
        return Summary(self.x[ends], np.add.reduceat(self.w, starts), self.err + int(hidden.max()))

    def bracket(self, rank: int) -> Interval:
        """(lo, hi]: holds the value of 0-based ``rank`` for sure."""
        cum = np.cumsum(self.w)
        a = int(np.searchsorted(cum, rank - self.err, side="right")) - 1        # last point with cum + err <= rank
        b = int(np.searchsorted(cum, rank + 1, side="left"))                    # first point with cum > rank
        return (float(self.x[a]) if a >= 0 else None), float(self.x[b])


class _Pass:
    """Counts and summaries of one task: rows up to each open interval's lower end, and a summary of what is in it."""

    def __init__(self, intervals: list[list[Interval]], points: int, buffer: int):
        self.intervals, self.buffer = intervals, buffer
        self.points = [max(min(points, LEAST), points // max(1, len(i))) for i in intervals]
        self.below = [np.zeros(len(i), dtype=np.int64) for i in intervals]
        self.inside: list[list[list[tuple[int, Summary]]]] = [[[] for _ in i] for i in intervals]     # (merges so far, summary)
        self.held: list[list[np.ndarray]] = [[] for _ in intervals]
        self.n_held = 0

    def add(self, columns: list[np.ndarray]) -> None:
        for c, v in enumerate(columns):
            self.held[c].append(v[~np.isnan(v)])
        self.n_held += len(columns[0])
        if self.n_held >= self.buffer:
            self.flush()

    def flush(self) -> None:
        for c, some in enumerate(self.held):
            self.held[c] = []
            if not some or not self.intervals[c]:
                continue
            v = np.sort(np.concatenate(some))
            for part, (lo, hi) in enumerate(self.intervals[c]):
                a, b = (0 if lo is None else np.searchsorted(v, lo, side="right")), np.searchsorted(v, hi, side="right")
                self.below[c][part] += a
                if b > a:
                    self.put(c, part, 0, Summary.of(v[a:b] + 0.0))             # -0.0 is 0.0
        self.n_held = 0

    def put(self, c: int, part: int, below: int, s: Summary | None) -> None:
        self.below[c][part] += below
        if s is None:
            return
        level, stack = 0, self.inside[c][part]
        while stack and stack[-1][0] <= level:
            s, level = stack.pop()[1].merged(s).thinned(self.points[c]), level + 1
        stack.append((level, s.thinned(self.points[c])))

    def summary(self, c: int, part: int) -> Summary:
        s = Summary(np.empty(0), np.empty(0, dtype=np.int64))
        for _, other in self.inside[c][part]:
            s = s.merged(other)
        return s.thinned(self.points[c])

    def rows(self, merger: int) -> Iterator[pa.RecordBatch]:
        out = []
        for c, parts in enumerate(self.inside):
            for part in range(len(parts)):
                s = self.summary(c, part)
                out.append((merger, c, part, int(self.below[c][part]), s.err, s.x.astype("<f8").tobytes(), s.w.astype("<i8").tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)],
                                             names=[f.split()[0] for f in _ROW.split(", ")])

    def merge(self, rows) -> None:
        for c, part, below, err, x, w in rows:
            s = Summary(np.frombuffer(x, "<f8"), np.frombuffer(w, "<i8"), err)
            self.put(c, part, below, s if len(s.x) else None)


def _fields(b: pa.RecordBatch | pa.Table):
    return zip(*(b.column(i).to_pylist() for i in range(1, 7)))


def _run(df: DataFrame, intervals: list[list[Interval]], points: int, buffer: int) -> _Pass:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Pass(intervals, points, buffer)
        for b in batches:
            if b.num_rows:
                p.add([col.to_numpy(zero_copy_only=False).astype(float, copy=False) for col in b.columns])
        p.flush()
        yield from p.rows(TaskContext.get().partitionId() % MERGERS)

    def merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Pass(intervals, points, buffer)
        for b in batches:
            p.merge(_fields(b))
        yield from p.rows(0)

    total = _Pass(intervals, points, buffer)
    total.merge(_fields(df.mapInArrow(task, _ROW).repartition(MERGERS, "merger").mapInArrow(merger, _ROW).toArrow()))
    return total


def _joined(brackets: list[Interval]) -> list[Interval]:
    """Overlapping intervals (lo, hi] as one."""
    out: list[Interval] = []
    for lo, hi in sorted(brackets, key=lambda i: (i[0] is not None, i)):
        if out and (lo is None or lo < out[-1][1]):
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _at_ranks(src: DataFrame, columns: int, probs: list[float], points: int, buffer: int) -> tuple[list[int], list[dict[int, float]]]:
    """How many values each column has, and those at the ranks next to p (n - 1)."""
    open_: list[list[Interval]] = [[(None, math.inf)] for _ in range(columns)]
    sizes: list[int] = []
    known: list[dict[int, float]] = [{} for _ in range(columns)]
    wanted: list[set[int]] = []
    while any(open_):
        found = _run(src, open_, points, buffer)
        stuck = False
        if not sizes:
            sizes = [int(found.summary(c, 0).w.sum()) for c in range(columns)]
            wanted = [{k for p in probs for h in [p * (n - 1)] for k in (math.floor(h), math.ceil(h))} if n else set()
                      for n in sizes]
        for c in range(columns):
            left = []
            for part, (least, most) in enumerate(open_[c]):
                s, below = found.summary(c, part), int(found.below[c][part])
                for k in wanted[c] - known[c].keys():
                    if below <= k < below + int(s.w.sum()):
                        lo, hi = s.bracket(k - below)
                        if s.err:
                            left.append((least if lo is None else lo, min(hi, most)))
                        else:
                            known[c][k] = hi
            before, open_[c] = open_[c], _joined(left)
            stuck |= bool(set(before) & set(open_[c]))
        points *= 4 if stuck else 1                              # an interval as wide as before needs finer summaries
    return sizes, known


def quantiles(df: DataFrame, columns: list[str], probs: list[float], points: int = POINTS,
              buffer: int = BUFFER) -> dict[str, list[float | None]]:
    """Interpolated quantiles (rank p (n - 1)) of each column; None for a column without values.

    NULL and NaN are left out.  ``df`` is read once, but for rows that no executor's disk or memory kept.
    """
    if not columns:
        return {}
    src = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    kept = None if df.is_cached else src.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes, known = _at_ranks(src, len(columns), probs, points, buffer)
    finally:
        if kept is not None:
            kept.unpersist()

    def value(c: int, p: float) -> float:
        h = p * (sizes[c] - 1)
        lo, hi = known[c][math.floor(h)], known[c][math.ceil(h)]
        if lo == hi or h == math.floor(h):
            return lo
        return (math.ceil(h) - h) * lo + (h - math.floor(h)) * hi

    return {name: [value(c, p) if sizes[c] else None for p in probs] for c, name in enumerate(columns)}
