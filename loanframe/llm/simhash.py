"""Near-duplicate grouping of SimHash fingerprints by the generalised pigeonhole principle (operator 13).

1. A fingerprint bit is the majority of that bit over a text's hashed word
   shingles.  Equal fingerprints are one class; classes are compared.
2. The 64 bits are dealt to ``PARTS`` partitions, correlated bits together
   (correlations are counted over all classes).  If thresholds of the
   partitions add up to ``distance - PARTS + 1``, two fingerprints within
   ``distance`` are within the threshold in some partition (-1: not probed).
3. Which thresholds is up to each class: dynamic programming takes the
   cheapest, given exactly how many classes lie within each threshold of its
   bits in a partition.  These counts are tables of 2^16 numbers a partition,
   whatever the number of documents.  A class in crowded partitions so probes others.
4. Members of a bucket are first linked with its commonest class, so that a
   crowd of near copies becomes one group at a linear cost.  Then classes
   probe: each finds all its neighbours of larger groups (a link between two
   groups is found by the smaller one), and every candidate is verified.  Members
   of a bucket's largest group ask nothing there, so crowds aren't paired up.
   Buckets are dealt to blocks on both sides; tasks stream them and hand on pairs of groups, not of documents.
5. Groups joined by links are merged with union-find.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanframe.llm.common import components, map_batches, stored, texts_of

BITS, PARTS = 64, 4
WIDTH = BITS // PARTS
SEED = 42
#: Data rows and probe rows of a bucket that meet in one place, and pairs compared at a time.
DATA_BLOCK, PROBE_BLOCK, PAIRS = 4096, 65_536, 1 << 20
#: What a probe row costs, in comparisons.
PROBE_COST = 8
#: Shingles hashed at a time.
CHUNK = 65_536


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit majority of the XXH64 of a text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(width, len(words))
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    spans = zip([0, *ends], ends[size - 1:])
    votes, n = np.zeros(BITS, dtype=np.int64), len(words) - size + 1
    while some := list(itertools.islice(spans, CHUNK)):
        h = np.array([xxhash.xxh64_intdigest(joined[a:b - 1], SEED) for a, b in some], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, width) for t in texts_of(b.column(1))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"doc_id {kind}, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _summed(df: DataFrame, count) -> dict[int, int]:
    """Sums of what ``count(batch)`` (an array of fixed length) gives over all rows, at the places that aren't zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = count(b) if total is None else total + count(b)
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])
    rows = df.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows["at"].to_pylist(), rows["n"].to_pylist()))


def _as_array(sums: dict[int, int], size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    out[list(sums.keys())] = list(sums.values())
    return out


def partition_bits(classes: DataFrame) -> np.ndarray:
    """The bits of each partition (PARTS x WIDTH), correlated ones together."""
    def count(b: pa.RecordBatch) -> np.ndarray:
        x = _bits(b.column(0).to_numpy()).astype(np.float32)
        return np.concatenate([(x.T @ x).astype(np.int64).ravel(), [len(x)]])
    sums = _as_array(_summed(classes.select("fp"), count), BITS * BITS + 1)
    n = max(int(sums[-1]), 1)
    both = sums[:-1].reshape(BITS, BITS) / n
    p = both.diagonal()
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs((both - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    return grouped_bits(near)


def grouped_bits(near: np.ndarray) -> np.ndarray:
    """Greedy groups of WIDTH bits: from the closest pair left, add the bit closest to the group."""
    left, out = set(range(BITS)), []
    for _ in range(PARTS):
        rest = sorted(left)
        a, b = np.unravel_index(np.argmax(near[np.ix_(rest, rest)]), (len(rest), len(rest)))
        group = list(dict.fromkeys([rest[a], rest[b]]))
        while len(group) < WIDTH:
            group.append(max((x for x in rest if x not in group), key=lambda x: (near[x, group].sum(), -x)))
        out.append(sorted(group))
        left -= set(group)
    return np.array(out)


def _values(fp: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """What each partition holds (rows x PARTS)."""
    packed = np.ascontiguousarray(np.packbits(_bits(fp)[:, parts.ravel()], axis=1, bitorder="little"))
    return packed.view("<u2").reshape(len(fp), PARTS).astype(np.int64)


def _within(counts: np.ndarray, distance: int) -> np.ndarray:
    """(PARTS, distance + 1, 2^WIDTH): how many classes lie within 0, 1, ... bits of each value of a partition."""
    exact = np.zeros((PARTS, distance + 1, 1 << WIDTH), dtype=np.int64)
    exact[:, 0] = counts
    value = np.arange(1 << WIDTH)
    for bit in range(WIDTH):
        flipped = exact[:, :, value ^ (1 << bit)]
        exact[:, 1:] += flipped[:, :-1]
    return exact.cumsum(axis=1)


def _masks(distance: int) -> list[np.ndarray]:
    """For each threshold 0 .. distance the changes of up to so many of WIDTH bits."""
    weight = np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint64))
    return [np.flatnonzero(weight <= t) for t in range(distance + 1)]


def allocate(values: np.ndarray, within: np.ndarray, distance: int) -> np.ndarray:
    """Thresholds plus one (rows x PARTS, adding up to distance + 1), of the least expected work for each row."""
    rows, size = len(values), distance + 2
    probes = [PROBE_COST * len(m) for m in _masks(distance)]
    best = np.full((rows, size), np.iinfo(np.int64).max // 4)
    best[:, 0] = 0
    taken = np.zeros((PARTS, rows, size), dtype=np.int8)
    for p in range(PARTS):
        cost = np.concatenate([np.zeros((1, rows), np.int64), within[p][:, values[:, p]] + np.array(probes)[:, None]])
        new = np.full_like(best, np.iinfo(np.int64).max // 4)
        for units in range(size):
            for spent in range(size - units):
                total = best[:, spent] + cost[units]
                less = total < new[:, spent + units]
                new[less, spent + units] = total[less]
                taken[p, less, spent + units] = units
        best = new
    out, left = np.zeros((rows, PARTS), dtype=np.int64), np.full(rows, distance + 1)
    for p in reversed(range(PARTS)):
        out[:, p] = taken[p, np.arange(rows), left]
        left -= out[:, p]
    return out


def _probes(fp: np.ndarray, root: np.ndarray, size: np.ndarray, parts: np.ndarray, top_size: np.ndarray,
            top_root: np.ndarray, within: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slot, row): the buckets (partition * 2^WIDTH + value) each row has to look into, but for those without a larger group."""
    values = _values(fp, parts)
    units, masks = allocate(values, within, distance), _masks(distance)
    for p in range(PARTS):
        for t in range(distance + 1):
            rows = np.flatnonzero(units[:, p] == t + 1)
            if len(rows):
                slot = (p << WIDTH) + (values[rows, p][:, None] ^ masks[t][None, :]).ravel()
                row = np.repeat(rows, len(masks[t]))
                asks = (size[row] < top_size[slot]) | ((size[row] == top_size[slot]) & (root[row] < top_root[slot]))
                yield slot[asks], row[asks]


_PLACED = "slot long, a int, b int, probe boolean, fp long, root long, size long"


def _placed(members: DataFrame, parts: np.ndarray, limits, sent, distance: int) -> DataFrame:
    """Data and probe rows of ``members`` (fp, root, size) where they meet: bucket, data block ``a``, probe block ``b``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, asking = sent.value
        blocks, shares = -(-data // DATA_BLOCK), -(-asking // PROBE_BLOCK)

        def out(slot, row, times, of_other, mine, fp, root, size, probe):
            """A row for each block of the other side."""
            other = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            slot, row = np.repeat(slot, times), np.repeat(row, times)
            own = (fp[row].view(np.uint64) % np.maximum(mine[slot], 1).astype(np.uint64)).astype(np.int32)
            other = other.astype(np.int32)
            a, b = (other, own) if probe else (own, other)
            return pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(a), pa.array(b), pa.array(np.full(len(slot), probe)), pa.array(fp[row]),
                 pa.array(root[row]), pa.array(size[row])], names=[f.split()[0] for f in _PLACED.split(", ")])

        for batch in batches:
            fp, root, size = (batch.column(c).to_numpy() for c in range(3))
            values = _values(fp, parts)
            for p in range(PARTS):
                slot = (p << WIDTH) + values[:, p]
                yield out(slot, np.arange(len(fp)), shares[slot], shares, blocks, fp, root, size, False)
            for slot, row in _probes(fp, root, size, parts, *limits.value, distance):
                for lo in range(0, len(slot), CHUNK):
                    s, r = slot[lo:lo + CHUNK], row[lo:lo + CHUNK]
                    yield out(s, r, blocks[s], blocks, shares, fp, root, size, True)
    return members.select("fp", "root", "size").mapInArrow(run, _PLACED)


def _met(distance: int):
    """Stream rows sorted by place, data before probes: distinct pairs of groups linked there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, data = None, [np.empty(0, np.int64)] * 3          # the place now read, and its data rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
            probe = batch.column(3).to_numpy(zero_copy_only=False)
            rows = [batch.column(c).to_numpy() for c in (4, 5, 6)]
            if place is not None and (key[:, 0] == place).all():  # data rows of this place came with earlier batches
                held = len(data[0])
                key = np.concatenate([np.repeat(place[:, None], held, axis=1), key], axis=1)
                probe = np.concatenate([np.zeros(held, bool), probe])
                rows = [np.concatenate([x, y]) for x, y in zip(data, rows)]
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            group = np.cumsum(np.bincount(starts, minlength=key.shape[1])) - 1
            n_data = np.bincount(group[~probe], minlength=len(starts))
            at = np.flatnonzero(probe)
            first, n = starts[group[at]], n_data[group[at]]
            found = [np.empty((0, 2), np.int64)]
            done = np.concatenate([[0], np.cumsum(n)])
            lo = 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(done, done[lo] + PAIRS, side="right")) - 1)
                times = n[lo:hi]
                x = np.repeat(at[lo:hi], times)
                y = np.repeat(first[lo:hi], times) + np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times)
                near = np.bitwise_count((rows[0][x] ^ rows[0][y]).view(np.uint64)) <= distance
                x, y = x[near], y[near]
                fewer = (rows[2][x] < rows[2][y]) | ((rows[2][x] == rows[2][y]) & (rows[1][x] < rows[1][y]))
                found.append(np.unique(np.stack([rows[1][x[fewer]], rows[1][y[fewer]]], axis=1), axis=0))
                lo = hi
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])
            mine = slice(starts[-1], starts[-1] + n_data[-1])
            place, data = key[:, -1], [r[mine] for r in rows]
    return run


def _groups(classes: DataFrame, parts: np.ndarray, distance: int) -> DataFrame:
    """(fp, rep, root, size): classes with the group that links to buckets' commonest classes give them."""
    def values(b: pa.RecordBatch) -> pa.RecordBatch:
        v = _values(b.column(0).to_numpy(), parts)
        slot = pa.array((v + (np.arange(PARTS) << WIDTH)).ravel(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * PARTS, pa.int32()), slot)],
            names=["fp", "docs", "slots"])
    rows = map_batches(classes.select("fp", "docs"), values, "fp long, docs long, slots array<long>")
    rows = rows.select("fp", "docs", F.explode("slots").alias("slot"))
    lead = rows.groupBy("slot").agg(F.max(F.struct("docs", "fp")).alias("m")).select("slot", F.col("m.fp").alias("v"))
    links = rows.join(F.broadcast(lead), "slot").where(    # lead: at most PARTS * 2^WIDTH rows
        (F.col("fp") != F.col("v")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= distance))
    found = components(links.select(F.col("fp").alias("u"), "v"))
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    found = found.join(sizes, "root").select(F.col("node").alias("fp"), "root", "size")
    out = classes.join(found, "fp", "left")
    return stored(out.select("fp", "rep", F.coalesce("root", "fp").alias("root"), F.coalesce("size", F.lit(1)).alias("size")),
                  "simhash-member")


def _links(members: DataFrame, parts: np.ndarray, distance: int) -> DataFrame:
    """Pairs (u, v) of groups with a verified link between them."""
    spark = members.sparkSession
    slots = PARTS << WIDTH

    def held(b: pa.RecordBatch) -> np.ndarray:
        v = _values(b.column(0).to_numpy(), parts) + (np.arange(PARTS) << WIDTH)
        return np.bincount(v.ravel(), minlength=slots)
    data = _as_array(_summed(members.select("fp"), held), slots)
    within = _within(data.reshape(PARTS, 1 << WIDTH), distance)
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, root, size = (b.column(c).to_numpy() for c in range(3))
            slot = _values(fp, parts) + (np.arange(PARTS) << WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(slot.ravel()), pa.array(np.repeat(root, PARTS)), pa.array(np.repeat(size, PARTS))],
                                             names=["slot", "root", "size"])
    top = members.select("fp", "root", "size").mapInArrow(tops, "slot long, root long, size long").groupBy("slot").agg(
        F.max(F.struct("size", "root")).alias("m")).select("slot", "m.size", "m.root").toArrow()
    top_size, top_root = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64)
    at = top["slot"].to_numpy()
    top_size[at], top_root[at] = top["size"].to_numpy(), top["root"].to_numpy()
    limits = spark.sparkContext.broadcast((top_size, top_root, within))

    def asked(b: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(slots, dtype=np.int64)
        for slot, _ in _probes(*(b.column(c).to_numpy() for c in range(3)), parts, *limits.value, distance):
            total += np.bincount(slot, minlength=slots)
        return total
    asking = _as_array(_summed(members.select("fp", "root", "size"), asked), slots)
    sent = spark.sparkContext.broadcast((data, asking))
    place = ["slot", "a", "b"]
    rows = _placed(members, parts, limits, sent, distance).repartition(*place).sortWithinPartitions(*place, "probe")
    return rows.mapInArrow(_met(distance), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    distance: int = 3) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of ``docs``.

    Linked are rows whose fingerprints differ in at most ``distance`` bits;
    ``component_id`` is the smallest id reachable over links.

    NULL and empty texts, and texts without words, have fingerprint zero and
    are linked like any other.  Rows that repeat an id keep their own
    fingerprints and components.  Rows without an id have a fingerprint and
    no component, and link nothing.  An empty table gives an empty result.  Other columns are ignored.
    """
    rows = stored(fingerprints(docs, id_col, text_col, width), "simhash-doc")
    classes = stored(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("docs")), "simhash-class")
    parts = partition_bits(classes)
    members = _groups(classes, parts, distance)
    merged = components(stored(_links(members, parts, distance), "simhash-link"))
    merged = merged.select(F.col("node").alias("root"), F.col("root").alias("whole"))
    whole = members.join(merged, "root", "left").select("fp", "rep", F.coalesce("whole", "root").alias("whole"))
    least = whole.groupBy("whole").agg(F.min("rep").alias("component_id"))
    ids = whole.join(least, "whole").select("fp", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return rows.join(ids, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))
