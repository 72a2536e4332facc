"""SentencePiece encoding and decoding with N-best segmentations (operator 3).

A text is a lattice of vocabulary pieces.  A forward Viterbi pass gives every
position the best score of reaching it; backward A-star search uses these as
its exact heuristic, so complete segmentations leave the queue best first and
the N best need no more work than N paths and their neighbours.

No piece goes on behind a space or across a line end, so the lattice falls
apart into words, and the N best of a text follow from those of its words.
With exact heuristics the least loss of changing a word can be read off the
edges beside its best path; only the N - 1 words of a text with the least
losses are searched, each once.  The worker keeps best paths and searched words in two
generations of bounded size: when the newer is full the older one goes, and
words that are met again move over, so frequent words stay.

Scores are those of the model file; a character without a piece is written as
byte pieces, each scored below every piece.  Decoding gives every text back
exactly, spaces, control characters and the model's own space mark included.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanframe.llm.common import passing

MARK = "▁"
#: Words in a generation of a worker's memory (about 200 bytes each), and ids of all of them.
REMEMBERED, REMEMBERED_IDS = 350_000, 6_000_000
#: Texts encoded together.
TOGETHER = 500
#: Signs that stand behind words.
SIGNS = ".,;:!?*$#%&|)]}\"'"
#: Words with the spaces before them, line ends, spaces at a line's end.
WORD = re.compile(r" *[^ \n]+|\n| +")


def default_model() -> str:
    """Path of the installed public model (32,000 pieces, byte fallback)."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """Pieces with scores; spaces stand for the model's space mark."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_first: int
    byte_score: float
    raw: list[bytes]
    #: Tree of the pieces' characters: a node is (next nodes by character, score, id), the last two None where it is no piece.
    trie: dict = field(default_factory=dict)
    #: The same of the pieces read backwards.
    backward_trie: dict = field(default_factory=dict)
    #: Characters that are pieces.
    single: set[str] = field(default_factory=set)
    #: Characters that some piece has side by side.
    pairs: set[str] = field(default_factory=set)
    #: Characters of the longest piece.
    longest: int = 1
    encoders: dict[int, "Encoder"] = field(default_factory=dict)

    def encoder(self, n: int) -> "Encoder":
        """The encoder of this worker, which outlives a task with the words it remembers."""
        if n not in self.encoders:
            self.encoders[n] = Encoder(self, n)
        return self.encoders[n]

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        """Read the model file (in the driver; the vocabulary is broadcast, about 2 MB)."""
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, raw, first = {}, {}, [], None
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                first = i if first is None else first
                raw.append(bytes([i - first]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                text = piece.replace(MARK, " ")
                ids[text], scores[text] = i, sp.get_score(i)
                raw.append(text.encode())
        if first is None:
            raise ValueError("the model has no byte pieces")
        return cls.build(ids, scores, first, raw)

    @classmethod
    def build(cls, ids, scores, first, raw) -> "Vocabulary":
        def tree(step: int) -> dict:
            root: dict = {}
            for p in sorted(ids, key=len):                      # shorter ones first: a node is made with its score
                kids, read = root, p[::step]
                for c in read[:-1]:
                    kids = kids.setdefault(c, ({}, None, None))[0]
                kids[read[-1]] = (kids.get(read[-1], ({},))[0], scores[p], ids[p])
            return root
        return cls(ids, scores, first, min(scores.values(), default=0.0) - 10.0, raw, tree(1), tree(-1), {p for p in ids if len(p) == 1},
                   {p[i:i + 2] for p in ids for i in range(len(p) - 1)}, max(map(len, ids), default=1))

    def edges(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For every end position the edges (start, score, ids) that reach it."""
        n = len(word)
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            kids, j = self.trie, i
            while j < n and (node := kids.get(word[j])) is not None:
                j += 1
                kids, gain, piece = node
                if gain is not None:
                    into[j].append((i, gain, (piece,)))
            if word[i] not in self.single:
                raw = word[i].encode("utf-8", "surrogatepass")
                into[i + 1].append((i, self.byte_score * len(raw), tuple(self.bytes_first + b for b in raw)))
        return into

    @staticmethod
    def forward(into: list) -> list[float]:
        """Viterbi: the best score of reaching every position."""
        best = [0.0]
        for edges in into[1:]:
            best.append(max([best[i] + s for i, s, _ in edges], default=float("-inf")))
        return best

    def best_of(self, words: list[str]) -> Iterator[tuple[str, list[int], float, float]]:
        """(word, ids, score, loss of the second best) of the best segmentation of each of sorted words.

        The forward pass with the two best scores of every position; the edge
        beside the best path that loses least is where the second best leaves it.
        A position's scores depend on the letters before it alone, so a word starts
        where it parts from the one before.
        """
        root, single, longest, low = self.backward_trie, self.single, self.longest, float("-inf")
        top, second, back, last = [0.0], [low], [None], ""
        for word in words:
            n, j = len(word), 0
            for x, y in zip(word, last):
                if x != y:
                    break
                j += 1
            del top[j + 1:], second[j + 1:], back[j + 1:]
            while j < n:
                j += 1
                first = next_ = low
                way, kids, i = None, root, j
                for c in word[max(0, j - longest):j][::-1]:
                    node = kids.get(c)
                    if node is None:
                        break
                    i -= 1
                    kids, gain, piece = node
                    if gain is not None:
                        score = top[i] + gain
                        if score >= first:                      # of equal ones the longest piece
                            first, next_, way = score, first, (i, piece)
                        elif score > next_:
                            next_ = score
                if word[j - 1] not in single:
                    raw = word[j - 1].encode("utf-8", "surrogatepass")
                    score = top[j - 1] + self.byte_score * len(raw)
                    if score > first:
                        first, next_, way = score, first, (j - 1, raw)
                    elif score > next_:
                        next_ = score
                top.append(first)
                second.append(next_)
                back.append(way)
            at, ids, gap = n, [], float("inf")
            while at:
                gap = min(gap, top[at] - second[at])
                at, piece = back[at]
                if isinstance(piece, int):
                    ids.append(piece)
                else:
                    ids.extend(self.bytes_first + x for x in reversed(piece))
            ids.reverse()
            last = word
            yield word, ids, top[n], gap

    def nbest(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations (score, ids) of a word, best first (A-star from its end).

        A position leaves the queue at most ``n`` times (later paths to it are no better), and of equal
        scores the newest goes on first, so equal segmentations don't multiply.
        """
        into = self.edges(word)
        best = self.forward(into)
        queue = [(-best[-1], 0, len(word), 0.0, None)]
        out, ticket, left = [], 0, [n] * (len(word) + 1)
        while queue and len(out) < n:
            _, _, at, done, path = heapq.heappop(queue)
            if at == 0:
                ids = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                out.append((done, tuple(ids)))
                continue
            if not left[at]:
                continue
            left[at] -= 1
            for i, s, piece in into[at]:
                ticket -= 1
                heapq.heappush(queue, (-(best[i] + s + done), ticket, i, done + s, (piece, path)))
        return out


def _combine(parts: list[tuple[int, list[tuple[float, tuple[int, ...]]]]], n: int) -> list[tuple[float, tuple]]:
    """The ``n`` smallest losses (loss, ((place, choice), ...)) of changing parts, no change first."""
    cur: list[tuple[float, tuple]] = [(0.0, ())]
    for place, options in parts:
        more = [(loss + options[0][0] - s, change + ((place, k),) if k else change)
                for loss, change in cur for k, (s, _) in enumerate(options)]
        cur = heapq.nsmallest(n, more)
    return cur


class _Words:
    """Words by number: ids laid end to end, and for each word score, loss of the second best and number of ids."""

    def __init__(self):
        self.code: dict[str, int] = {}
        self.ids, self.first, self.count = array("i"), array("q"), array("i")
        self.score, self.gap = array("d"), array("d")
        self.options: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def add(self, word: str, ids, score: float, gap: float) -> int:
        code = self.code[word] = len(self.first)
        self.first.append(len(self.ids))
        self.count.append(len(ids))
        self.ids.extend(ids)
        self.score.append(score)
        self.gap.append(gap)
        return code

    def entry(self, code: int) -> tuple[array, float, float]:
        lo = self.first[code]
        return self.ids[lo:lo + self.count[code]], self.score[code], self.gap[code]

    def full(self) -> bool:
        return len(self.first) >= REMEMBERED or len(self.ids) >= REMEMBERED_IDS or len(self.options) >= REMEMBERED


@dataclass
class Encoded:
    """Texts encoded together: ids laid end to end, text k from ``starts[k]`` to ``starts[k + 1]``; ``alternatives``
    of each text as (score, changes), a change (first, count, ids) replacing ``count`` ids from number ``first``."""

    ids: np.ndarray
    starts: np.ndarray
    scores: np.ndarray
    alternatives: list[list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]


class Encoder:
    """Encodes texts with a vocabulary; remembers words it has seen."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.v, self.n = vocabulary, n
        self.now, self.before = _Words(), _Words()

    def _learn(self, words: set[str]) -> None:
        """Put words into the newer memory, from the older one or by searching their best segmentations."""
        now, old = self.now, self.before
        split, whole = [], set()
        for word in words:
            core = len(word.rstrip(SIGNS))
            if word not in old.code and 0 < core < len(word) and word[core - 1:core + 1] not in self.v.pairs:
                # no piece goes on from the word to the signs behind it: each has its own best
                split.append((word, word[:core], word[core:]))
                whole.update(split[-1][1:])
            else:
                whole.add(word)
        whole.difference_update(now.code)
        for word in whole & old.code.keys():
            now.add(word, *old.entry(old.code[word]))
        for word, ids, score, gap in self.v.best_of(sorted(whole - old.code.keys())):
            now.add(word, ids, score, gap)
        for word, core, signs in split:
            a, b = now.entry(now.code[core]), now.entry(now.code[signs])
            now.add(word, a[0] + b[0], a[1] + b[1], min(a[2], b[2]))

    def _options(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best of a word in the newer memory, its best one first."""
        got = self.now.options.get(word) or self.before.options.get(word)
        if got is None:
            ids, score, _ = self.now.entry(self.now.code[word])
            first = tuple(ids)
            rest = [(s, x) for s, x in self.v.nbest(word, self.n + 1) if x != first]
            got = [(score, first), *rest[:self.n - 1]]
        self.now.options[word] = got
        return got

    def encode_all(self, texts: list[str]) -> Encoded:
        if self.now.full():
            self.before, self.now = self.now, _Words()
        get = self.now.code.get
        words: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                words += WORD.findall(" " + text)
            ends.append(len(words))
        self._learn(set(words).difference(self.now.code))
        codes = list(map(get, words))
        code, ends = np.array(codes, dtype=np.int64), np.array(ends)
        count, first, score, gap, flat = (np.array(x) for x in (self.now.count, self.now.first, self.now.score, self.now.gap, self.now.ids))
        size = count[code].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.arange(upto[-1]) + np.repeat(first[code] - upto[:-1], size)].astype(np.int32)
        gains = score[code]
        scores = np.array([float(gains[a:b].sum()) for a, b in zip(ends, ends[1:])])
        out = Encoded(ids, upto[ends], scores, [[] for _ in texts])
        if self.n > 1:
            losses = gap[code]
            for k, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                if a < b:
                    out.alternatives[k] = self._alternatives(words, losses, a, b, float(scores[k]), size, upto)
        return out

    def _alternatives(self, words, losses, a: int, b: int, score: float, size, upto):
        """Second to ``n``-th best of the text of words ``a`` to ``b``: changes of the words with the least losses."""
        few = []
        for _ in range(min(self.n - 1, b - a)):
            at = a + int(losses[a:b].argmin())
            if losses[at] == np.inf:
                break
            few.append(at)
            losses[at] = np.inf
        options = {at: self._options(words[at]) for at in sorted(few)}
        start = int(upto[a])
        return [(score - loss, [(int(upto[at]) - start, int(size[at]), options[at][c][1]) for at, c in change])
                for loss, change in _combine(list(options.items()), self.n)[1:]]

    def encode(self, text: str) -> tuple[bytes, float, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]:
        """(ids as int32 bytes, score, alternatives) of a text."""
        got = self.encode_all([text])
        return got.ids.tobytes(), float(got.scores[0]), got.alternatives[0]


def _alternative_column(alternatives) -> pa.Array:
    """Arrow column of ``Encoded.alternatives``, from flat lists."""
    sizes, scores, n_changes, first, count, n_ids, ids = [0], [], [0], [], [], [0], []
    for text in alternatives:
        for score, changes in text:
            scores.append(score)
            for f, c, x in changes:
                first.append(f)
                count.append(c)
                ids.extend(x)
                n_ids.append(len(ids))
            n_changes.append(len(first))
        sizes.append(len(scores))

    def lists(ends, values):
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    change = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(count, pa.int32()), lists(n_ids, pa.array(ids, pa.int32()))],
                                        names=["first", "count", "ids"])
    alternative = pa.StructArray.from_arrays([pa.array(scores, pa.float64()), lists(n_changes, change)], names=["score", "changes"])
    return lists(sizes, alternative)


def vocabulary(path: str | None = None) -> Vocabulary:
    return Vocabulary.load(path or default_model())


CHANGE = "array<struct<first:int,count:int,ids:array<int>>>"


def encode(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", n: int = 3,
           keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """(id, ids, n_pieces, score, alternatives) of every row; the text and other columns where named in ``keep``.

    With ``decoded``, a column of this name has the text that the ids decode
    to, from the same pass (one Python worker a task instead of two).

    ``alternatives``: the second to ``n``-th best segmentation as score and
    changes to the best one's ids.  NULL and empty texts have no ids and score
    0; repeated rows are encoded alike; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    src, out, back = passing(docs, id_col, text_col, keep, [
        ("ids", "array<int>"), ("n_pieces", "long"), ("score", "double"),
        ("alternatives", f"array<struct<score:double,changes:{CHANGE}>>"), *([(decoded, "string")] if decoded else [])])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sent.value.encoder(n)
        raw = pa.array([*sent.value.raw, b""], pa.large_binary())
        for whole in batches:
            for i in range(0, whole.num_rows, TOGETHER):       # a few MB of ids at a time
                b = whole.slice(i, TOGETHER)
                got = enc.encode_all([t or "" for t in b.column(1).to_pylist()])
                ids = pa.ListArray.from_arrays(pa.array(got.starts, pa.int32()), pa.array(got.ids))
                new = [ids, pa.array(np.diff(got.starts), pa.int64()), pa.array(got.scores), _alternative_column(got.alternatives)]
                if decoded:
                    new.append(pa.array(decode_ids(got.ids, got.starts, raw), pa.string()))
                yield back(b, new)

    return src.mapInArrow(run, out)


def decode_ids(ids: np.ndarray, starts: np.ndarray, raw: pa.LargeBinaryArray) -> list[str]:
    """Texts of ids laid end to end, text k from ``starts[k]`` to ``starts[k + 1]``, without the space put before each.

    ``raw``: the bytes of every piece and, last, of no piece.  Unknown ids are
    empty, broken UTF-8 is replaced.
    """
    unknown = len(raw) - 1
    got = raw.take(pa.array(np.where((ids >= 0) & (ids < unknown), ids, unknown).astype(np.int64)))
    _, offsets, data = got.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[got.offset:got.offset + len(ids) + 1]
    data = data.to_pybytes() if data is not None else b""
    at = ends[starts].tolist()
    texts = [data[a:b] for a, b in zip(at, at[1:])]
    return [(t[1:] if t[:1] == b" " else t).decode("utf-8", "replace") for t in texts]


def decode(encoded: DataFrame, vocab: Vocabulary, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids added; NULL ids give an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocab.raw)
    rest = [c for c in encoded.columns if c != text_col]
    src = encoded.select(*rest)
    at = rest.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = pa.array([*sent.value, b""], pa.large_binary())
        for b in batches:
            ids = b.column(at).fill_null([])
            texts = decode_ids(ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]), raw)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*rest, text_col])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(text_col, T.StringType())]))


def report(spark: SparkSession, docs: DataFrame, path: str | None = None, n: int = 3) -> DataFrame:
    """Ids, score and alternatives of every document, and the digest of what its ids decode to."""
    vocab = vocabulary(path)
    out = encode(docs, vocab, n=n, decoded="decoded")
    return out.select("doc_id", "ids", "n_pieces", "score", "alternatives",
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
