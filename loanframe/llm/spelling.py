"""Spelling variant grouping by permuterm rotations (operator 11).

1. Words are counted over all documents: maximal runs of Latin letters, A-Z
   lower-cased, some with one letter deleted (``perturbed``).  Tasks add up
   their own counts before the shuffle, so a very frequent word is a few rows.
2. A word marked with a terminator has one rotation for every letter.  With a
   letter rotated to the end, all words that differ in that letter alone share
   the rest of the rotation, and a word without that letter *is* the rest.  So
   replacements and indels are the rows of one prefix, one position at a time.
   Rotations are sorted by that prefix and every group is scanned once.
   Words of more than ``SPELT`` letters take part with two rolling hashes of
   what stands before and after the position in place of the letters, so a
   word costs rows in proportion to its length, and what meets is compared.
3. A group has at most one row for each letter of the alphabet and one for the
   shorter word.  Of every member the scan emits how many others are near and
   the best of them, never pairs.
4. Forms lead to words of at least ``ratio`` times the count, so chains are
   short; pointer doubling over joins finds their last words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanframe.llm.common import GOLD, mix64, stored

#: Marks a word's end in a rotation; no letter.
END = "$"
LETTERS = "a-zÀ-ÿ"
#: Distinct words a task gathers before it hands on their counts, and rows it scans at a time.
GATHER, SCAN = 200_000, 65_536

#: Letters up to which a rotation is written out.
SPELT = 255

MEMBER = "word string, n_near long, best_n long, best string"


def perturbed(doc: int, run: str) -> str:
    """``run`` as it counts in a document with prefix checksum ``doc``: one in 31 loses a letter."""
    h = zlib.crc32(run.encode(), doc)
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7,
                least_count: int = 2) -> DataFrame:
    """(word, n) of all words of at least ``least_letters`` letters and ``least_count`` occurrences."""
    runs = re.compile(f"[{LETTERS}]{{{least_letters},}}")       # shorter runs can't become longer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())],
                                              names=["word", "n"])
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                doc = zlib.crc32(f"{'' if key is None else key}:".encode())
                for found, n in Counter(runs.findall(text.lower().decode())).items():     # bytes: A-Z alone
                    word = perturbed(doc, found)
                    if len(word) >= least_letters:
                        total[word] += n
                if len(total) >= GATHER:
                    yield out()
                    total = Counter()
        yield out()

    src = docs.select(F.col(id_col).cast("string"), F.col(text_col))
    return (src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


def rotations(words: DataFrame) -> DataFrame:
    """(key, letter, first, n): every rotation of every word, once whole (letter empty) and once for the prefix
    before its last letter.  ``first``: the letter differs from the one before it in the word; of equal letters in a
    row only one stands for an insertion, so a pair of words meets in one group only."""
    at = words.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("word"))))
    whole = at.select(F.expr(f"concat(substring(word, at + 1), '{END}', left(word, at))").alias("key"),
                      F.lit("").alias("letter"), F.lit(True).alias("first"), "n")
    prefix = at.where("at > 0").select(
        F.expr(f"concat(substring(word, at + 1), '{END}', left(word, at - 1))").alias("key"),
        F.expr("substring(word, at, 1)").alias("letter"),
        F.expr("at = 1 OR substring(word, at, 1) <> substring(word, at - 1, 1)").alias("first"), "n")
    return whole.union(prefix)


def _scanned(key: str, group: list[tuple[str, bool, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, count and name of the best one) for members of one prefix that have near words in it."""
    right, _, left = key.partition(END)
    ordered = sorted((-n, left + letter + right, first, not letter) for letter, first, n in group)
    longer = [m for m in ordered if not m[3]]
    shorter = len(longer) < len(ordered)
    for me in ordered:
        if me[3]:                                              # near those with one letter more
            near = [m for m in longer if m[2]]
        elif me[2]:
            near = ordered
        else:
            near = longer
        n = len(near) if me[3] else len(longer) - 1 + (shorter and me[2])
        if n:
            best = near[0] if near[0] is not me else near[1]
            yield me[1], n, -best[0], best[1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan rows sorted by key; a group may go over batches."""
    def groups(t: pa.Table, last: bool):
        keys = t["key"].combine_chunks()
        new = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], new.nonzero()[0] + 1, [len(keys)] if last else []]).astype(np.int64)
        size = np.diff(cuts)
        several = t.slice(0, cuts[-1]).filter(pa.array(np.repeat(size > 1, size)))
        columns = [several[c].to_pylist() for c in ("letter", "first", "n")]
        names, at, found = several["key"].to_pylist(), 0, []
        for n in size[size > 1].tolist():
            found.extend(_scanned(names[at], list(zip(*(c[at:at + n] for c in columns)))))
            at += n
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        rows = zip(*found) if found else ((),) * 4
        out = [pa.array(x, kind) for x, kind in zip(rows, kinds)]
        return pa.RecordBatch.from_arrays(out, names=[f.split()[0] for f in MEMBER.split(", ")]), t.slice(int(cuts[-1]))

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= SCAN:
            out, rest = groups(pa.Table.from_batches(held), False)
            yield out
            held = rest.to_batches()
    if sum(x.num_rows for x in held):
        yield groups(pa.Table.from_batches(held), True)[0]


_FACTORS = tuple(np.uint64(f) for f in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))    # odd, so they have inverses


def _hashed_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, size, a, b, c, d, letter, first, id, n) of words (id, word, n): a-d stand for what is before and
    after the place.  A whole word has letter 0."""
    for batch in batches:
        for key, word, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            code = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            before, after, without = [], [], []
            for f in _FACTORS:
                power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(code) - 1, f, dtype=np.uint64), dtype=np.uint64)])
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(code * GOLD + f) * power, dtype=np.uint64)])
                before.append(sums)
                after.append(sums[-1] - sums)
                without.append(after[-1][1:] * np.uint64(pow(int(f), -1, 1 << 64)))
            first = np.concatenate([[True], code[1:] != code[:-1]])
            place = np.arange(len(code) + 1)
            for size, at, sides, letter, start in (
                    (len(code), place, (*before, *after), np.zeros(len(code) + 1, np.int32), np.ones(len(code) + 1, bool)),
                    (len(code) - 1, place[:-1], (*(x[:-1] for x in before), *without), code.astype(np.int32), first)):
                for lo in range(0, len(at), SCAN):
                    cut = slice(lo, lo + SCAN)
                    rows = len(at[cut])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at[cut]), pa.array(np.full(rows, size)), *(pa.array(x[cut].view(np.int64)) for x in sides),
                         pa.array(letter[cut]), pa.array(start[cut]), pa.array(np.full(rows, key)), pa.array(np.full(rows, n))],
                        names=["place", "size", "a", "b", "c", "d", "letter", "first", "id", "n"])


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point leads from ``a`` to ``b``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    x, y = (np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32) for w in sorted((a, b), key=len))
    apart = np.flatnonzero(x != y[:len(x)])
    at = int(apart[0]) if len(apart) else len(x)
    return bool(np.array_equal(x[at + (len(x) == len(y)):], y[at + 1:]))


def _near_long(words: DataFrame) -> DataFrame:
    """Rows like the scan's, one for each near word, of words (word, n) of which one of two has more than ``SPELT`` letters."""
    ids = stored(words.where(F.length("word") >= SPELT).withColumn("id", F.xxhash64("word")), "spelling-long")
    rows = ids.select("id", "word", "n").mapInArrow(
        _hashed_rotations, "place long, size long, a long, b long, c long, d long, letter int, first boolean, id long, n long")
    key = ["place", "size", "a", "b", "c", "d"]
    mine = rows.select(*key, F.col("letter").alias("l1"), F.col("first").alias("f1"), F.col("id").alias("i1"))
    theirs = rows.select(*key, F.col("letter").alias("l2"), F.col("first").alias("f2"), F.col("id").alias("i2"))
    met = mine.join(theirs, key).where("l1 <> l2 AND ((l1 > 0 AND l2 > 0) OR (f1 AND f2))").select("i1", "i2").distinct()
    a = ids.select(F.col("id").alias("i1"), "word")
    b = ids.select(F.col("id").alias("i2"), F.col("word").alias("best"), F.col("n").alias("best_n"))
    pairs = met.join(a, "i1").join(b, "i2").where(F.greatest(F.length("word"), F.length("best")) > SPELT)

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            yield t.filter(pa.array([one_edit(x, y) for x, y in zip(t["word"].to_pylist(), t["best"].to_pylist())], pa.bool_()))
    return pairs.select("word", F.lit(1).cast("long").alias("n_near"), "best_n", "best").mapInArrow(sure, MEMBER)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n) for every row of ``words`` (word, n), distinct words.

    Near: one code point inserted, deleted or replaced.  ``best``: the near
    word of the largest n, of equal ones the smallest in code-point order;
    NULL where nothing is near.
    """
    spelt = rotations(words.where(F.length("word") <= SPELT))
    scanned = spelt.repartition("key").sortWithinPartitions("key").mapInArrow(_scan, MEMBER).union(_near_long(words))
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"),
                       F.lit(None).cast("string").alias("best"))
    rows = own.unionByName(scanned.withColumn("n", F.lit(None).cast("long")))
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    out = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("b"))
    return out.select("word", "n", "n_near", F.col("b.word").alias("best"), (-F.col("b.less")).alias("best_n"))


def last_forms(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without cycles: the last word that forms lead to, by pointer doubling."""
    cur = stored(links.select("word", F.col("form").alias("root")), "spelling-link")
    while True:
        on = cur.select(F.col("word").alias("root"), F.col("root").alias("on"))
        nxt = stored(cur.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"),
                                                         F.col("on").isNotNull().alias("moved")), "spelling-root")
        cur = nxt.select("word", "root")
        if not nxt.where("moved").take(1):
            return cur


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7,
             least_count: int = 2, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of ``docs``.

    ``form`` is the best near word, if it occurs at least ``ratio`` times as
    often, else NULL; ``root`` the last word that forms lead to (the word
    itself without a form).  NULL and empty texts have no words; a NULL id
    counts as the empty id; rows that repeat an id, and repeated rows, all
    count; an empty table has no words.  Other columns are ignored.
    """
    words = stored(word_counts(docs, id_col, text_col, least_letters, least_count), "spelling-word")
    near = near_words(words)
    is_form = F.col("best_n") >= ratio * F.col("n")
    near = stored(near.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"),
                              F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-near")
    roots = last_forms(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
