import random
import zlib
from collections import Counter

import duckdb
import pytest

from loanframe.llm import queries as Q
from loanframe.llm import spelling as S
from tests.conftest import SF_SMALL

ABC = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def _counts(rows, least=7):
    """Letter by letter, one occurrence at a time."""
    n = Counter()
    for doc, text in rows:
        run = ""
        for c in (text or "") + " ":
            low = c.lower() if "A" <= c <= "Z" else c
            if low in ABC:
                run += low
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                w = run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]
                if len(w) >= least:
                    n[w] += 1
            run = ""
    return {w: k for w, k in n.items() if k >= 2}


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _brute(n, ratio=10):
    out, form = {}, {}
    for w in n:
        near = [x for x in n if _one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = [form[w], None, n[w], len(near), n[best] if form[w] else None]
    for w in n:
        at = w
        while form[at] is not None:
            at = form[at]
        out[w][1] = at
    return {w: tuple(v) for w, v in out.items()}


def _got(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_dense_words_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "GATHER", 20)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("aaaaÿ÷") for _ in range(rnd.randint(6, 9))) for _ in range(60)]
    rows = [(d, " ".join(rnd.choice(words[: rnd.choice([2, 8, 60])]) for _ in range(rnd.randint(0, 90)))) for d in range(60)]
    rows.append((99, "qwertyuiop " * 2 + "qwertyuiopé " * 30 + "qwertyuiopéz " * 300))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = _got(S.variants(docs))
    want = _brute(_counts(rows))
    assert got == want and any(v[1] not in (w, v[0]) for w, v in want.items())     # a chain of two forms
    assert any(v[3] > 3 for v in want.values())


def test_scan_of_groups_over_batches(spark, monkeypatch):
    words = spark.createDataFrame([(a + b + "xxxxx", 3) for a in "abcé" for b in "abdé"], "word string, n long")
    rows = S.rotations(words).orderBy("key").toArrow()
    whole = [r for b in S._scan(iter(rows.to_batches())) for r in b.to_pylist()]
    monkeypatch.setattr(S, "SCAN", 7)
    parts = [r for b in S._scan(iter(rows.to_batches(max_chunksize=3))) for r in b.to_pylist()]
    assert parts == whole and len(whole) > 30


def test_edges(spark):
    word = "Ünmöglich"                                         # Ü stays, only A-Z are lowered
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, f"{word} {word}", "y", 2), (3, "short words Only", "z", 3),
            (3, "short words Only", "z", 3), (4, "wonderful WONDERFUL wonderful", "w", 1), (4, "wonderfull wonderful! 9wonderful_", "w", 1),
            (5, "x" * 200_000 + " " + "x" * 200_000, "v", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    got = _got(S.variants(docs))
    assert got == _brute(_counts([r[:2] for r in rows]))
    assert got["x" * 200_000][2] == 2 or got["x" * 199_999][2] == 2
    assert S.variants(docs.limit(0)).count() == 0
    assert S.variants(docs.where("doc_id < 3")).count() == 0


def test_long_words_meet_by_hashes(spark, monkeypatch):
    rnd = random.Random(8)
    made = {"".join(rnd.choice("aaÿb") for _ in range(rnd.randint(7, 10))) for _ in range(150)}
    words = spark.createDataFrame([(w, rnd.randint(2, 5)) for w in made], "word string, n long")
    want = {tuple(r) for r in S.near_words(words).collect()}
    for limit in (0, 8):
        monkeypatch.setattr(S, "SPELT", limit)
        assert {tuple(r) for r in S.near_words(words).collect()} == want
    assert all(S.one_edit(a, b) == _one_edit(a, b) for a in made for b in made if a != b)


def test_repeated_letters_count_once(spark):
    n = {"aaaaaaa": 5, "aaaaaaaa": 60, "aaaabaaa": 2, "bbbbbbbb": 2}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in S.near_words(words).collect()}
    assert got == {"aaaaaaa": (2, "aaaaaaaa", 60), "aaaaaaaa": (2, "aaaaaaa", 5), "aaaabaaa": (2, "aaaaaaaa", 60),
                   "bbbbbbbb": (0, None, None)}


def test_last_forms_of_long_chains(spark):
    links = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(17)], "word string, form string")
    got = {r["word"]: r["root"] for r in S.last_forms(links).collect()}
    assert got == {f"w{i:02}": "w17" for i in range(17)}


@pytest.mark.parametrize("sf", [SF_SMALL])
def test_documents_match_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cur = con.execute(Q.OP11_SQL)
    names = [d[0] for d in cur.description]
    want = {r[names.index("word")]: tuple(r[names.index(c)] for c in ("form", "root", "n", "n_near", "form_n")) for r in cur.fetchall()}
    assert _got(Q.op11_spelling_variants(spark, sf)) == want and len(want) > 1000
