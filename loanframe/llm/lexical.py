"""Ranked lexical search with pipelined term partitioning (operator 12).

The index is split by term over owners, from rare to common terms.  A bundle
of items visits the owners one after another and carries a sparse accumulator
of integer scores for every slice of documents; at each owner a cogroup on
(bundle, slice) adds the contributions of that owner's postings.

1. One pass over the texts counts terms.  A slice is what a task reads in a
   row, at most ``SLICE`` documents; a term's postings in a slice are one row,
   so a term of a third of all documents is spread over the slices.  Only
   postings whose term may be an item's are written, by a bitmap of fixed size.
2. A posting's share of a score depends on the corpus in two numbers, those of
   documents and of terms; then it is an integer, and sums are exact in any order.
3. After each owner the tenth best score of an item is a lower bound for what its
   results need, and the postings still to come bound what a document
   can gain.  A document that can't get there leaves the accumulator; none
   that could is dropped, equal scores included.
4. The last owner returns each slice's best documents, of which the best overall are ranked.

Item terms go to the postings by a join salted over slices, whose sides Spark
broadcasts only if they are small.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanframe.llm.common import FILTER_BITS, stored

#: Documents in a slice and items in a bundle: an accumulator has at most their product of scores (8 MB).
SLICE, BUNDLE = 4096, 256
#: Least weights (in thousandths) of an owner's terms, but for the last owner, which has the rest.
OWNERS = (6000, 4000, 2500)
#: Parts of a term's slices in the join with the items that ask for it.
SALT = 16
#: Every byte of ASCII that is neither letter nor digit parts terms (bytes above 7F belong to other characters).
_PARTS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order: A-Z lower-cased, runs of other than ASCII signs, spaces and controls."""
    return text.lower().translate(_PARTS).split()


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(bundle, item, item_id, term, times): terms of every row of ``items``, rows numbered inside bundles."""
    kind = items.schema[item_col].dataType.simpleString()
    n = items.count()
    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("bundle", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n // (BUNDLE // 2))))))
    rows = rows.withColumn("item", F.row_number().over(W.partitionBy("bundle").orderBy("row")) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, text in enumerate(b.column(3).cast(pa.binary()).to_pylist()):
                found = Counter(terms_of(text or b""))
                one = b.slice(at, 1).select([0, 1, 2])
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array([0] * len(found), pa.int32())) for c in one.columns),
                     pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())],
                    names=["bundle", "item", "item_id", "term", "times"])
    return stored(rows.select("bundle", "item", "item_id", "text").mapInArrow(
        run, f"bundle long, item int, item_id {kind}, term string, times long"), "lexical-item")


def _wanted(terms: DataFrame) -> np.ndarray:
    """Bitmap of the checksums of the items' terms: ``FILTER_BITS`` bits, whatever their number."""
    at = terms.select((F.crc32(F.col("term").cast("binary")) % FILTER_BITS + 1).alias("h"))
    rows = at.groupBy(F.expr("bitmap_bucket_number(h)").alias("b")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("m")).collect()
    whole = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(r["m"], dtype=np.uint8)
        whole[(r["b"] - 1) * len(part):][:len(part)] = part
    return whole


def _postings(docs: DataFrame, id_col: str, text_col: str, wanted: np.ndarray) -> DataFrame:
    """Two kinds of rows.  One for each slice, term NULL: ids of its documents and, in ``tf``, how many have terms
    and how many terms they have.  One for each term in a slice: places of documents in the slice (ids ascending),
    occurrences and lengths.  Terms that no item has may be among them."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, part, number = sent.value, TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        sizes: list[int] = []
        found: list[dict[bytes, int]] = []

        def out():
            nonlocal number
            all_ids = pa.concat_arrays(ids)
            order = pc.array_sort_indices(all_ids, null_placement="at_start").to_pylist()
            places: dict[bytes, tuple[list[int], list[int], list[int]]] = {}
            for place, at in enumerate(order):
                for term, tf in found[at].items():
                    p = places.setdefault(term, ([], [], []))
                    p[0].append(place)
                    p[1].append(tf)
                    p[2].append(sizes[at])
            number += 1
            rows = len(places) + 1
            longs = pa.list_(pa.int64())
            totals = [sum(s > 0 for s in sizes), sum(sizes)]
            ids_of = pa.ListArray.from_arrays([0] + [len(all_ids)] * rows, all_ids.take(pa.array(order, pa.int64())))
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number] * rows, pa.int64()),
                 pa.concat_arrays([pa.array([None], pa.string()), pa.array(places, pa.binary()).cast(pa.string())]),
                 pa.array([[], *(p[0] for p in places.values())], pa.list_(pa.int32())),
                 pa.array([totals, *(p[1] for p in places.values())], longs),
                 pa.array([[], *(p[2] for p in places.values())], longs), ids_of],
                names=["slice", "term", "place", "tf", "length", "ids"])

        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for lo in range(0, len(texts), SLICE):
                ids.append(b.column(0).slice(lo, SLICE))
                for text in texts[lo:lo + SLICE]:
                    words = terms_of(text or b"")
                    counts = Counter(words)
                    at = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % FILTER_BITS
                    may = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
                    sizes.append(len(words))
                    found.append({w: n for (w, n), m in zip(counts.items(), may.tolist()) if m})
                if len(sizes) + min(SLICE, len(texts)) > SLICE:
                    yield out()
                    ids, sizes, found = [], [], []
        if sizes:
            yield out()

    return docs.select(id_col, text_col).mapInArrow(
        run, f"slice long, term string, place array<int>, tf array<long>, length array<long>, ids array<{kind}>")


def _shares(postings: DataFrame, n: int, total: int) -> DataFrame:
    """(slice, term, place, share, most): what each posting gives for a weight of one, and the most of a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tf, size = (b.column(c).flatten().to_numpy() for c in (3, 4))
            share = (1_000_000_000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n) // total))
            place = b.column(2)
            starts = place.offsets.to_numpy() - place.offsets[0].as_py()
            most = np.maximum.reduceat(share, starts[:-1]) if b.num_rows else share
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), place.flatten()),
                 pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(share)), pa.array(most)],
                names=["slice", "term", "place", "share", "most"])
    rows = postings.where("term IS NOT NULL").select("slice", "term", "place", "tf", "length")
    return rows.mapInArrow(run, "slice long, term string, place array<int>, share array<long>, most long")


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy()


def _visit(k: int, last: bool):
    """What an owner does for a bundle in a slice: add its postings to the accumulator, let hopeless documents go.

    From the last owner only the ``k`` best documents of an item go on.
    """
    def run(carried: pa.Table, owned: pa.Table) -> pa.Table:
        places = [_flat(t["place"]) for t in (carried, owned)]
        docs = 1 + max((int(p.max()) for p in places if len(p)), default=0)
        asked = _flat(owned["items"])
        items = 1 + max(int(asked.max()) if len(asked) else 0, max(carried["item"].to_pylist(), default=0))
        score = np.zeros((items, docs), dtype=np.int64)
        sizes = np.diff(carried["place"].combine_chunks().offsets.to_numpy())
        score[np.repeat(carried["item"].to_numpy(), sizes), places[0]] = _flat(carried["score"])
        bar = np.zeros(items, dtype=np.int64)
        columns = [owned[c].combine_chunks() for c in ("items", "weights", "bars", "place", "share")]
        for at in range(owned.num_rows):
            who, weight, least, place, share = (c[at].values.to_numpy() for c in columns)
            score[np.ix_(who, place)] += weight[:, None] * share[None, :]
            bar[who] = least
        keep = (score > 0) & (score >= bar[:, None])
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for item in np.flatnonzero(keep.any(axis=1)).tolist():
            place = np.flatnonzero(keep[item])
            if last:
                place = place[np.lexsort((place, -score[item, place]))[:k]]
            out.append((item, place, score[item, place]))
        t = carried if carried.num_rows else owned
        return pa.table({
            "bundle": pa.array([t["bundle"][0].as_py()] * len(out), pa.int64()),
            "slice": pa.array([t["slice"][0].as_py()] * len(out), pa.int64()),
            "item": pa.array([x[0] for x in out], pa.int32()),
            "place": pa.array([x[1].astype(np.int32) for x in out], pa.list_(pa.int32())),
            "score": pa.array([x[2] for x in out], pa.list_(pa.int64()))})
    return run


def _kth_best(carried: DataFrame, k: int) -> DataFrame:
    """(bundle, item, kth): the k-th best score so far, for items with k documents."""
    each = carried.select("bundle", "item", F.explode(F.slice(F.sort_array("score", asc=False), 1, k)).alias("score"))
    order = W.partitionBy("bundle", "item").orderBy(F.desc("score"))
    return (each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("bundle", "item")
            .agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k).drop("n"))


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every row of ``items``, with a score above 0.

    Equal scores rank by ascending id (a NULL id first).  NULL and empty texts
    have no terms: such documents are found by nothing, such items find
    nothing.  Rows that repeat an id are documents (or items) of their own.
    Empty tables give an empty result.  Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    asks = _item_terms(items, item_col, item_text_col)
    postings = stored(_postings(docs, id_col, text_col, _wanted(asks)), "lexical-posting")
    heads = postings.where("term IS NULL")
    n, total = heads.agg(F.sum(F.col("tf")[0]), F.sum(F.col("tf")[1])).first()
    n, total = n or 0, max(total or 0, 1)
    shares = stored(_shares(postings, n, total), "lexical-share")

    stats = shares.groupBy("term").agg(F.sum(F.size("place")).alias("df"), F.max("most").alias("most"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long")
    owner = sum(((F.col("weight") < least).cast("int") for least in OWNERS), F.lit(0))
    asks = asks.join(stats.select("term", "most", weight.alias("weight")), "term").where("weight > 0")
    asks = stored(asks.select("bundle", "item", "item_id", "term", (F.col("times") * F.col("weight")).alias("weight"),
                              "most", owner.alias("owner")), "lexical-ask")
    rest = asks.groupBy("bundle", "item").agg(*(
        F.sum(F.when(F.col("owner") > s, F.col("weight") * F.col("most")).otherwise(0)).alias(f"rest{s}")
        for s in range(len(OWNERS) + 1)))

    spark = docs.sparkSession
    carried = spark.createDataFrame([], "bundle long, slice long, item int, place array<int>, score array<long>")
    owners = sorted(r["owner"] for r in asks.select("owner").distinct().collect())
    kth = spark.createDataFrame([], "bundle long, item int, kth long")
    for s in owners:
        bars = rest.join(kth, ["bundle", "item"], "left").select(
            "bundle", "item", (F.coalesce("kth", F.lit(0)) - F.col(f"rest{s}")).alias("bar"))
        own = asks.where(F.col("owner") == s).join(bars, ["bundle", "item"])
        own = own.groupBy("bundle", "term").agg(F.collect_list(F.struct("item", "weight", "bar")).alias("a"))
        own = own.select("bundle", "term", F.col("a.item").alias("items"), F.col("a.weight").alias("weights"),
                         F.col("a.bar").alias("bars"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        owned = shares.withColumn("salt", F.pmod(F.xxhash64("slice"), F.lit(SALT)).cast("int")).join(own, ["term", "salt"])
        owned = owned.select("bundle", "slice", "items", "weights", "bars", "place", "share")
        carried = carried.groupBy("bundle", "slice").cogroup(owned.groupBy("bundle", "slice")).applyInArrow(
            _visit(k, s == owners[-1]), "bundle long, slice long, item int, place array<int>, score array<long>")
        carried = stored(carried, "lexical-carried")
        if s != owners[-1]:
            kth = _kth_best(carried, k)

    best = carried.select("bundle", "slice", "item", F.explode(F.arrays_zip("place", "score")).alias("d"))
    ids = heads.select("slice", "ids")
    best = best.join(ids, "slice").select("bundle", "item", F.col("ids")[F.col("d.place")].cast(kind).alias("doc_id"),
                                          F.col("d.score").alias("score"))
    order = W.partitionBy("bundle", "item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asks.select("bundle", "item", "item_id").distinct()
    return ranked.join(names, ["bundle", "item"]).select("item_id", "rank", "doc_id", "score")
