"""Benchmark decontamination with a generalised suffix automaton (operator 5).

Test items are normalised to words and put into one generalised suffix
automaton over word numbers.  A training text streams through it word by
word; after each word the automaton's state stands for the longest run of
words, ending here, that occurs in some item, and its length is tracked.
Where that length reaches ``window`` words, the last ``window`` words are a
window of an item; the state at that length knows of which items.  Items
shorter than a window count when they occur whole.

Documents are mapped where they are read: no shuffle.  Items are collected in
blocks of at most ``BLOCK_BYTES`` (a proven bound on what is broadcast), and
each block streams all documents; with more than one block the hits are
carried through a table in the shared folder between blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanframe.llm.common import stored

#: Bytes of item text in one automaton: about 100,000 words, 150 MB of states in a worker.
BLOCK_BYTES = 512 * 1024
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased (UTF-8 bytes above 7F are all non-ASCII).
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SPANS = "array<struct<first:long,last:long>>"


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(key, [self.ids.setdefault(w, len(self.ids)) for w in words]) for key, words in items if words]
        for _, seq in coded:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        # for each state: the ancestor (or itself) whose strings include the last ``window`` words
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.window_state = list(range(len(self.length)))
        for s in by_length:
            if self.length[self.link[s]] >= window:
                self.window_state[s] = self.window_state[self.link[s]]
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for key, seq in coded:
            if len(seq) < window:
                state = 0
                for word in seq:
                    state = self.next[state][word]
                self.short.setdefault(state, []).append((len(seq), key))
            else:
                for _, state, length in self.stream(seq):
                    if length >= window:
                        self.windows.setdefault(self.window_state[state], set()).add(key)
        # for each state: the nearest ancestor (or itself) that ends a short item
        self.near_short = [0] * len(self.length)
        for s in by_length:
            self.near_short[s] = s if s in self.short else self.near_short[self.link[s]]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(edges)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """State of the strings of ``q`` no longer than those of ``p`` plus a word."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.next[p][word])
        return new

    def stream(self, seq: Iterable[int | None]) -> Iterator[tuple[int, int, int]]:
        """(position, state, longest match that ends here) after every word that occurs in an item."""
        step, link, length = self.next, self.link, self.length
        state = run = 0
        for at, word in enumerate(seq):
            to = step[state].get(word)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = step[state].get(word)
            if to is None:
                run = 0
            else:
                state = to
                run += 1
                yield at, state, run

    def search(self, words: list[bytes]) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Longest match, merged hit spans (first word, last word), items."""
        longest, spans, items = 0, [], set()
        window = self.window
        get = self.ids.get
        for at, state, run in self.stream([get(w) for w in words]):
            if run > longest:
                longest = run
            begin = at + 1
            if run >= window:
                begin = at + 1 - window
                items |= self.windows[self.window_state[state]]
            up = self.near_short[state]
            while up > 0:                                      # at most window - 1 lengths
                for size, key in self.short[up]:
                    if size <= run:
                        begin = min(begin, at + 1 - size)
                        items.add(key)
                up = self.near_short[self.link[up]]
            if begin <= at:
                while spans and spans[-1][1] >= begin - 1:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, at))
        return longest, spans, items


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", window: int = 10, cut_text: bool = False) -> DataFrame:
    """Rows (id, text, n_words, n_hit, longest, items, spans) of all ``docs``.

    ``items``: ids (as strings) of the items with an occurring window;
    ``spans``: (first, last) word positions of the merged hits; ``longest``:
    longest run of words found in any item.  NULL and empty texts have no
    words and no hits; an empty item table hits nothing; repeated rows are
    answered alike; columns other than id and text are ignored.  With
    ``cut_text`` the text comes back without its hit spans.
    """
    items = items.select(F.col(item_col).cast("string").alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    cur = docs.select(id_col, text_col, F.lit(None).cast("array<string>").alias("items"),
                      F.lit(None).cast(SPANS).alias("spans"), F.lit(0).cast("long").alias("longest"))
    schema = T.StructType(cur.schema.fields + [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType())])
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == block).collect()
        sent = docs.sparkSession.sparkContext.broadcast([(r["k"], r["t"].encode()) for r in rows])
        last = block + 1 == blocks

        def run(batches, sent=sent, cutting=cut_text and last):
            auto = Automaton([(k, words_of(t)) for k, t in sent.value], window)
            for b in batches:
                yield _search_batch(auto, b, cutting)

        cur = cur.select(cur.columns[:5]).mapInArrow(run, schema)
        if not last:
            cur = stored(cur, "decontam")
    return cur


def _search_batch(auto: Automaton, batch: pa.RecordBatch, cutting: bool) -> pa.RecordBatch:
    texts = batch.column(1).to_pylist()
    n_words, n_hit, far, keys, spans = [], [], [], [], []
    for i, (text, items0, spans0, longest0) in enumerate(zip(
            texts, *(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
        words = words_of((text or "").encode())
        longest, got, items = auto.search(words)
        if spans0:
            got = merge([(s["first"], s["last"]) for s in spans0] + got)
        n_words.append(len(words))
        n_hit.append(sum(b - a + 1 for a, b in got))
        far.append(max(longest, longest0))
        keys.append(sorted(items | set(items0 or ())))
        spans.append([{"first": a, "last": b} for a, b in got])
        if cutting:
            texts[i] = cut(text, got)
    pair = pa.struct([("first", pa.int64()), ("last", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(texts, pa.string()), pa.array(keys, pa.list_(pa.string())),
         pa.array(spans, pa.list_(pair)), pa.array(far, pa.int64()), pa.array(n_words, pa.int64()),
         pa.array(n_hit, pa.int64())], names=[*batch.schema.names, "n_words", "n_hit"])


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of ``spans`` and what stands between them."""
    if not spans or text is None:
        return text
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.lower())]
    left, end = [], 0
    for a, b in spans:
        left.append(raw[end:at[a][0]])
        end = at[b][1]
    return b"".join([*left, raw[end:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = 10,
                  max_coverage: float = 0.5) -> DataFrame:
    """``docs`` with hit spans cut out of their texts; rows with a larger share of hit words go.

    All columns stay.  Rows without a hit keep their text as it is, NULL included.
    """
    rest = [c for c in docs.columns if c != text_col]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), F.col(text_col).alias("_text"))
    hit = find_overlaps(row, items, "_row", "_text", window=window, cut_text=True)
    hit = hit.where(F.col("n_hit") <= F.col("n_words") * max_coverage)
    return hit.select(*[(F.col("_text") if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Hit counts per document, with the ids of its items as one digest."""
    f = find_overlaps(docs, items, window=window)
    return f.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
