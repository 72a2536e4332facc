"""Near-duplicate grouping with SuperMinHash (operator 1).

1. Each text becomes a set of hashed word shingles and a SuperMinHash
   signature: every element walks the signature's positions in its own random
   order and offers rank + fraction, so the ranks at the positions are
   correlated (each occurs once) and the variance is below MinHash's.  The walk stops early,
   once every position holds a value below the next rank.
2. Texts of equal sets are one class.  Class representatives meet in ``BANDS``
   buckets; 25 bands of 4 rows miss a pair of similarity 0.85 with
   probability 1e-8, one of 0.8 with 2e-6.
3. Every member of a bucket is verified against the bucket's smallest member
   on the full shingle sets, and linked members are grouped by union-find.
4. Buckets whose members are still in different groups may hold more links.
   Members of different groups whose signatures agree well enough form crowds
   (union-find again, inside blocks of a bucket and then over all), and each
   crowd is searched on full sets, in block pairs.  Both steps hand on only
   links that join trees, so no group's pairs are ever written out, and pairs within a
   group need no look: a bucket with thousands of copies costs as many
   comparisons as it has members.

No bucket is capped; nothing but counts reaches the driver.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanframe.llm.common import GOLD, components, map_batches, maybe_among, mix64, shingle_set, stored, texts_of, word_hashes

POSITIONS, BANDS, ROWS = 100, 25, 4
#: Signature agreement below which a pair can't be similar: six standard deviations below the threshold.
MARGIN = 6.0
#: Texts and bytes in a block of a bucket or crowd.
BLOCK, BLOCK_BYTES = 1024, 32 << 20


def superminhash(elements: np.ndarray, m: int = POSITIONS) -> np.ndarray:
    """SuperMinHash signature (m values of rank * 2^32 + fraction) of distinct 64-bit elements."""
    sig = np.full(m, np.iinfo(np.uint64).max, dtype=np.uint64)
    n = len(elements)
    if not n:
        return sig
    rows = np.arange(n)
    order = None
    for j in range(m):
        z = mix64(elements + np.uint64((j + 1) * int(GOLD) & (1 << 64) - 1))
        k = j + (((z >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            at, first = k, k
        else:
            at = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
            order[:, j] = at
        np.minimum.at(sig, at, (np.uint64(j) << np.uint64(32)) | (z & np.uint64(0xFFFFFFFF)))
        if sig.max() < np.uint64(j + 1) << np.uint64(32):
            break
        if order is None:
            order = np.tile(np.arange(m, dtype=np.uint8), (n, 1))
            order[rows, first] = 0
            order[:, 0] = first
    return sig


def text_set(text: bytes, width: int) -> np.ndarray:
    """Shingle set of a text: A-Z lower-cased, words between ASCII white space."""
    return shingle_set(word_hashes(text.lower()), width)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, signature as 4 bytes a position); NULL digest: no words."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        size, digest, sig = [], [], []
        for text in texts_of(b.column(1)):
            s = text_set(text, width)
            size.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig.append(mix64(superminhash(s)).astype(np.uint32).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
            names=["doc_id", "n_shingles", "digest", "sig"])
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run,
                       f"doc_id {kind}, n_shingles long, digest binary, sig binary")


def _verify(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs (u, v) whose full sets satisfy den * intersection >= num * union."""
    a = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu"))
    b = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", "tu", "tv")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, last, seen = [], None, None
        for tu, tv in zip(texts_of(batch.column(2)), texts_of(batch.column(3)), strict=True):
            if tv is not last and tv != last:          # the bucket's smallest member comes many times in a row
                last, seen = tv, text_set(tv, width)
            x = text_set(tu, width)
            common = len(np.intersect1d(x, seen, assume_unique=True))
            keep.append(den * common >= num * (len(x) + len(seen) - common))
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kinds = dict(pairs.dtypes)
    return map_batches(both, run, f"u {kinds['u']}, v {kinds['v']}")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, rep, leader, n): members of every bucket of at least two classes, its smallest member and its size."""
    rows = classes.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).select("rep", F.xxhash64(
        "band", F.substring(F.col("sig"), F.col("band") * (4 * ROWS) + 1, F.lit(4 * ROWS))).alias("key"))
    leaders = rows.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    return rows.join(leaders, "key").select("key", "rep", "leader", "n")


class _Forest:
    """Union-find inside one task; ``join`` says whether two trees were joined."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _by_block_pair(rows: DataFrame, group: str, work: Callable[[pa.Table], list[tuple[int, int]]], kind: str) -> DataFrame:
    """``work`` on every (group, i, j) of ``rows(group, i, j, ...)``, streamed from sorted partitions: pairs (u, v)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in itertools.chain(batches, [None]):
            if b is None:
                t, last = rest, True
            else:
                t, last = pa.Table.from_batches([b]), False
                t = t if rest is None else pa.concat_tables([rest, t])
            if t is None or not t.num_rows:
                continue
            place = np.stack([t[c].to_numpy() for c in (group, "i", "j")])
            ends = (np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist()
            cuts = [0, *ends, *([t.num_rows] if last else [])]
            found = [p for x, y in zip(cuts, cuts[1:]) for p in work(t.slice(x, y - x))]
            yield pa.RecordBatch.from_arrays([pa.array([max(p) for p in found], pa.int64()),
                                              pa.array([min(p) for p in found], pa.int64())], names=["u", "v"])
            rest = t.slice(cuts[-1])

    n = [group, "i", "j"]
    out = rows.repartition(*n).sortWithinPartitions(*n).mapInArrow(run, "u long, v long")
    return out.select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v")).distinct()


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of block i and of block j (the same rows where i = j)."""
    blk = t["blk"].to_numpy()
    return np.flatnonzero(blk == t["i"][0].as_py()), np.flatnonzero(blk == t["j"][0].as_py())


def _paired(rows: DataFrame, group: str, blocks) -> DataFrame:
    """Deal the rows of each group to ``blocks`` hashed blocks and send each to every pair of its block."""
    m = rows.withColumn("blk", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    return m.withColumns({"i": F.least("blk", "other"), "j": F.greatest("blk", "other")}).drop("other")


def _alike(members: DataFrame, classes: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """Links (u, v) between members of one bucket, in different groups, whose signatures agree in at least
    ``least`` of the positions; only as many as connect them.

    Pairs with the bucket's leader have been verified and are left out, and so
    are buckets of two and members of the leader's group among themselves.
    """
    roots = groups.select(F.col("node").alias("rep"), "root")
    m = members.where("n > 2").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    own = roots.select(F.col("rep").alias("leader"), F.col("root").alias("home"))
    m = m.join(own, "leader", "left").withColumn("home", F.coalesce("home", "leader"))
    m = stored(m.where("rep <> leader").select("key", "rep", "root", "home"), "neardup-member")
    counts = (m.groupBy("key").agg(F.count_if(F.col("root") != F.col("home")).alias("strays"), F.count("*").alias("n"))
              .where("strays > 0 AND n > 1"))
    m = _paired(m.join(counts, "key"), "key", F.ceil(F.col("n") / BLOCK)).drop("home", "strays", "n")
    m = m.join(classes.select("rep", "sig"), "rep").select("key", "i", "j", "blk", "rep", "root", "sig")

    def work(t: pa.Table) -> list[tuple[int, int]]:
        left, right = _sides(t)
        rep, root = t["rep"].to_numpy(), t["root"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=np.uint32).reshape(len(rep), POSITIONS)
        forest, out = _Forest(), []
        for at in left.tolist():
            to = right[root[right] != root[at]]
            for other in to[(sig[to] == sig[at]).sum(axis=1) >= least * POSITIONS].tolist():
                if forest.join(at, other):
                    out.append((int(rep[at]), int(rep[other])))
        return out

    return _by_block_pair(m, "key", work, dict(classes.dtypes)["rep"])


def _links_inside(crowds: DataFrame, texts: DataFrame, groups: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """True links inside crowds (node, root) between different groups, on full sets; only as many as connect them.

    Every member's text goes to its crowd's block pairs; there shingles are
    numbered and intersections counted by matrix products.  Blocks have at most
    about ``BLOCK`` texts and ``BLOCK_BYTES``.
    """
    known = groups.select(F.col("node").alias("rep"), F.col("root").alias("home"))
    m = crowds.select(F.col("node").alias("rep"), F.col("root").alias("crowd")).join(known, "rep", "left")
    m = m.withColumn("home", F.coalesce("home", "rep")).join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    m = stored(m, "neardup-crowd")
    size = m.groupBy("crowd").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"),
                                  F.countDistinct("home").alias("homes")).where("homes > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("b") / BLOCK_BYTES), F.lit(1))
    m = _paired(m.join(size, "crowd"), "crowd", blocks).select("crowd", "i", "j", "blk", "rep", "home", "text")

    def work(t: pa.Table) -> list[tuple[int, int]]:
        left, right = _sides(t)
        rep, home = t["rep"].to_pylist(), t["home"].to_pylist()
        sets = [text_set(x, width) for x in texts_of(t["text"].combine_chunks())]
        size = np.array([len(x) for x in sets], dtype=np.int64)
        common = _intersections([sets[k] for k in left], [sets[k] for k in right])
        near = den * common >= num * (size[left][:, None] + size[right][None, :] - common)
        forest, out = _Forest(), []
        for a, b in np.argwhere(near).tolist():
            x, y = left[a], right[b]
            if x != y and forest.join(home[x], home[y]):
                out.append((rep[x], rep[y]))
        return out

    return _by_block_pair(m, "crowd", work, dict(crowds.dtypes)["root"])


def _intersections(a: list[np.ndarray], b: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    if not a or not b:
        return out
    shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    places = [[np.searchsorted(shared, s[np.isin(s, shared, assume_unique=True)]) for s in side] for side in (a, b)]
    for lo in range(0, len(shared), columns):
        dense = []
        for side in places:
            m = np.zeros((len(side), min(columns, len(shared) - lo)), dtype=np.float32)
            for r, p in enumerate(side):
                m[r, p[np.searchsorted(p, lo):np.searchsorted(p, lo + columns)] - lo] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    num: int = 80, den: int = 100) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Linked are rows with den * intersection >= num * union of their ``width``-word
    shingle sets; ``component_id`` is the smallest id reachable over links.

    Texts that are NULL, empty or without words have no shingles and no links.
    Rows that repeat an id are one document to the links (equal rows, equal
    answers).  Rows without an id are linked with nothing: component_id NULL,
    kept.  Ids are integers.  Other columns of ``docs`` are ignored; an empty
    table gives an empty result.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    feats = stored(signatures(src, "doc_id", "text", width), "neardup-sig")
    usable = feats.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")),
                     "neardup-class")
    members = stored(_buckets(classes), "neardup-bucket")
    star = stored(members.where("rep <> leader").select(F.col("rep").alias("u"), F.col("leader").alias("v")).distinct(),
                  "neardup-star")
    near = star.select(F.col("u").alias("doc_id")).union(star.select("v")).distinct()
    texts = stored(maybe_among(src, "doc_id", near).join(near, "doc_id")
                   .dropDuplicates(["doc_id", "text"]), "neardup-text")
    links = stored(_verify(star, texts, width, num, den), "neardup-link")
    groups = components(links)
    share = num / den
    least = share - MARGIN * (share * (1 - share) / POSITIONS) ** 0.5
    crowds = components(_alike(members, classes, groups, least))
    more = stored(_links_inside(crowds, texts, groups, width, num, den), "neardup-more")
    if more.take(1):
        groups = components(links.union(more))
    ids = usable.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest")
    ids = ids.join(groups.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        "doc_id", F.coalesce("root", "rep").alias("component_id"))
    ids = ids.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = feats.select("doc_id", "n_shingles").join(ids, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
             num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the smallest id.

    Rows are compared by their texts alone: rows that repeat an id are different
    documents unless their texts are alike.  Of a group's rows that repeat its
    smallest id one stays, by a hash of its text.  Rows without an id or without
    words all stay.
    """
    made = docs.withColumns({"_near_row": F.monotonically_increasing_id(), "_near_hash": F.xxhash64(text_col)})
    rows = stored(made, "neardup-row")                       # fixes the row numbers
    known = rows.where(F.col(id_col).isNotNull())
    found = near_duplicates(known, "_near_row", text_col, width, num, den)
    found = stored(found.select(F.col("doc_id").alias("_near_row"), "component_id", "kept"), "neardup-found")
    several = found.where("NOT kept").select("component_id").distinct()
    order = F.struct(F.col(id_col).alias("id"), F.col("_near_hash").alias("hash"), F.col("_near_row").alias("row"))
    members = (found.select("_near_row", "component_id").join(several, "component_id", "left_semi")
               .join(known.select("_near_row", order.alias("order")), "_near_row"))
    best = members.groupBy("component_id").agg(F.min("order").alias("first"))
    gone = members.join(best.select("component_id", F.col("first.row").alias("stays")), "component_id").where(
        "_near_row <> stays").select("_near_row")
    return rows.join(gone, "_near_row", "left_anti").drop("_near_row", "_near_hash")
