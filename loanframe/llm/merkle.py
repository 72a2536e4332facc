"""Document fingerprints from Merkle trees (operator 7).

A text is cut into paragraphs (lines) and each paragraph into leaves (clauses
of about 40 bytes).  A leaf's digest hashes its bytes, a paragraph's the
digests of its leaves, a section's those of its paragraphs, the root's those
of the sections.  Sections are content-defined: one ends after a paragraph
whose digest has three zero bits, so an insertion moves no later section.
Equal roots mean equal texts; where roots differ, only branches with
different digests need a look (``locate_edits``).

The fingerprint string is the root and every distinct leaf digest, so the
likeness of two texts is exact and can be told from their fingerprints alone.
It grows with the text: 16 hex digits for about 40 bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loanframe.llm.common import map_batches, texts_of

#: Up to 40 bytes without a clause's end, the rest of the last word, then ends and white space.
LEAF = re.compile(rb"[^\n.!?]{1,40}[^\s.!?]*[.!?\s]*|[.!?\s]+")
LINE = re.compile(rb"[^\n]*\n|[^\n]+")


@dataclass(frozen=True)
class Node:
    """A node over the bytes [first, last) of its text."""

    digest: bytes
    first: int
    last: int
    children: tuple["Node", ...] = ()


def _parent(children: list[Node], at: int) -> Node:
    digest = hashlib.blake2b(b"".join(c.digest for c in children), digest_size=16).digest()
    return Node(digest, children[0].first if children else at, children[-1].last if children else at, tuple(children))


def tree(text: bytes) -> Node:
    """Merkle tree of a text: root, sections, paragraphs, leaves.  The empty text is a root without children."""
    paragraphs, sections, at = [], [], 0
    for line in LINE.findall(text):
        leaves = []
        for piece in LEAF.findall(line):
            leaves.append(Node(xxhash.xxh3_64_digest(piece), at, at + len(piece)))
            at += len(piece)
        paragraphs.append(_parent(leaves, at))
        if paragraphs[-1].digest[0] & 7 == 0:
            sections.append(_parent(paragraphs, at))
            paragraphs = []
    if paragraphs:
        sections.append(_parent(paragraphs, at))
    return _parent(sections, at)


def locate_edits(old: bytes, new: bytes) -> list[tuple[int, int]]:
    """Byte ranges of ``new`` that aren't in ``old``, found by descending branches of unknown digest."""
    return differing(branches(tree(old)), tree(new))


def branches(root: Node) -> set[bytes]:
    """Digests of all nodes of a tree."""
    known, left = set(), [root]
    while left:
        node = left.pop()
        known.add(node.digest)
        left.extend(node.children)
    return known


def differing(known: set[bytes], root: Node) -> list[tuple[int, int]]:
    """Byte ranges of a tree's leaves under no branch of a digest in ``known``."""
    out: list[tuple[int, int]] = []

    def descend(node):
        if node.digest in known:
            return
        if node.children:
            for c in node.children:
                descend(c)
        elif out and out[-1][1] == node.first:
            out[-1] = (out[-1][0], node.last)
        elif node.last > node.first:
            out.append((node.first, node.last))

    descend(root)
    return out


def _print(root: Node) -> str:
    leaves = {leaf.digest for s in root.children for p in s.children for leaf in p.children}
    return root.digest.hex() + ":" + b"".join(sorted(leaves)).hex()


def fingerprint(text: bytes) -> str:
    """Root (32 hex digits), a colon, and all distinct leaf digests (16 hex digits each, ascending)."""
    return _print(tree(text))


def likeness(a: str, b: str) -> float:
    """Share (0 to 1) of distinct leaves that two fingerprints have in common (Dice).

    Equal roots are 1; the empty text is like nothing else.
    """
    if a[:32] == b[:32]:
        return 1.0
    x = {a[i:i + 16] for i in range(33, len(a), 16)}
    y = {b[i:i + 16] for i in range(33, len(b), 16)}
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def fingerprints(df: DataFrame, texts: dict[str, str], likes: dict[str, tuple[str, str]] | None = None,
                 keep: Iterable[str] = (), sections: dict[str, str] | None = None,
                 edits: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Columns ``keep``, a fingerprint for every ``{new name: text column}`` and a likeness for every pair of those.

    ``sections`` ({new name: fingerprint}) adds the digests of a text's sections
    in order, ``edits`` ({new name: (old, new) fingerprint}) the byte ranges of
    the new text that aren't in the old one.

    NULL texts are empty; an empty table gives an empty result.
    """
    likes, keep, sections, edits = likes or {}, list(keep), sections or {}, edits or {}
    spans = "array<struct<first:bigint,last:bigint>>"
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, T.StringType()) for n in texts]
                          + [T.StructField(n, T.DoubleType()) for n in likes]
                          + [T.StructField(n, T.ArrayType(T.StringType())) for n in sections]
                          + [T.StructField(n, T.DataType.fromDDL(spans)) for n in edits])
    names = list(texts)
    at = {n: i for i, n in enumerate(names)}
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = [[] for _ in schema.names[len(keep):]]
        last: tuple[bytes, Node, str] | None = None
        for row in zip(*(texts_of(b.column(len(keep) + i)) for i in range(len(names))), strict=True):
            made = {}
            for t in row:
                if t not in made:
                    if last and last[0] == t:                # the next text of the row before
                        made[t] = last[1:]
                    else:
                        root = tree(t)
                        made[t] = root, _print(root)
            last = (row[-1], *made[row[-1]])
            got = [made[t] for t in row]
            values = [g[1] for g in got]
            values += [likeness(got[at[p]][1], got[at[q]][1]) for p, q in likes.values()]
            values += [[s.digest.hex() for s in got[at[n]][0].children] for n in sections.values()]
            values += [[{"first": x, "last": y} for x, y in differing(branches(got[at[p]][0]), got[at[q]][0])]
                       for p, q in edits.values()]
            for col, v in zip(cols, values, strict=True):
                col.append(v)
        kinds = [pa.string()] * len(names) + [pa.float64()] * len(likes) + [pa.list_(pa.string())] * len(sections) + [span] * len(edits)
        return pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                          names=schema.names)

    return map_batches(df.select(*keep, *texts.values()), run, schema)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", next_col: str = "next_text") -> DataFrame:
    """Add the text of the next row by ascending (id, text); after the last comes the first.

    Rows are dealt to ranges of ids (quantiles, at most four a shuffle
    partition), and the first row of each range is also sent to the range
    before it, so one window per range finds every successor: one shuffle of
    the texts and no task with more than its range.  NULL ids come first.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    d = docs.select(id_col, F.col(text_col), key.alias("_key"))
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / most for i in range(1, most)]
    at = d.select(F.percentile_approx("_key", cuts, 10 * most).alias("q")).first()["q"] or []
    splits = [float("-inf"), *sorted({float(x) for x in at}), float("inf")]
    if len(splits) > 2:
        deal = Bucketizer(splits=splits, inputCol="_at", outputCol="_range")
        d = deal.transform(d.withColumn("_at", F.col("_key").cast("double"))).drop("_at")
    else:
        d = d.withColumn("_range", F.lit(0.0))
    heads = sorted((r["_range"], r["h"]) for r in d.groupBy("_range").agg(F.min("_key").alias("h")).collect())
    if not heads:
        return d.select(id_col, text_col, F.lit(None).cast("string").alias(next_col))
    before = [(heads[i][0], heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
    small = spark.createDataFrame(before, "_range double, _head long, _before double")   # a row for each range
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("peek"))
    peek = F.struct(F.col("_before").alias("r"), F.lit(1).alias("peek"))
    sent = d.join(F.broadcast(small), "_range").withColumn(
        "_to", F.explode(F.when(F.col("_key") == F.col("_head"), F.array(own, peek)).otherwise(F.array(own))))
    nxt = F.lead(text_col).over(W.partitionBy("_to.r").orderBy("_to.peek", "_key", text_col))
    return sent.withColumn(next_col, nxt).where("_to.peek = 0").select(id_col, text_col, next_col)


def edits_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit: the last quarter gives way to the next document's beginning."""
    d = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    tail = F.floor(F.length("text") / 4).cast("int")
    d = d.withColumns({
        "n_chars": F.length("text").cast("long"),
        "edited": F.concat(F.left("text", F.length("text") - tail), F.left("next_text", tail))})
    d = d.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    out = fingerprints(
        d, {"fingerprint": "text", "edited_fingerprint": "edited", "next_fingerprint": "next_text"},
        {"near_edited": ("fingerprint", "edited_fingerprint"), "near_next": ("fingerprint", "next_fingerprint")},
        keep=["doc_id", "n_chars", "edited_sha256"], sections={"sections": "fingerprint", "edited_sections": "edited_fingerprint"},
        edits={"edits": ("fingerprint", "edited_fingerprint")})
    return out.drop("next_fingerprint")
