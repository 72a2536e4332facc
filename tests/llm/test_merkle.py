import hashlib
import random

from pyspark.sql import functions as F

from loanframe.llm import merkle as M
from loanframe.llm import queries as Q
from tests.conftest import SF_SMALL


def test_roots_tell_equality_and_trees_cover_texts():
    rnd = random.Random(3)
    texts = [b"", b"\n", b"a", b"x" * 500, b"One. Two! Three?\n\nFour five six.\n", "é ü\n. .".encode()]
    texts += [bytes(rnd.choice(b"ab .\n!") for _ in range(rnd.randint(0, 300))) for _ in range(200)]
    for t in texts:
        root = M.tree(t)
        leaves = [x for s in root.children for p in s.children for x in p.children]
        assert b"".join(t[x.first:x.last] for x in leaves) == t
        assert M.fingerprint(t)[:32] == root.digest.hex()
    prints = {}
    for t in texts:
        assert prints.setdefault(M.fingerprint(t), t) == t


def test_edits_are_located():
    base = "\n".join(f"Paragraph {i} says something. It goes on for a while, number {i * 37}." for i in range(200)).encode()
    at = base.index(b"number 3700")
    new = base[:at] + b"NUMBER" + base[at + 6:]
    spans = M.locate_edits(base, new)
    assert len(spans) == 1 and spans[0][0] <= at < at + 6 <= spans[0][1] and spans[0][1] - spans[0][0] < 120
    assert M.locate_edits(base, base) == [] and M.locate_edits(b"", b"") == []
    moved = b"A new paragraph in front.\n" + base
    assert M.locate_edits(base, moved) == [(0, 26)]
    assert 0.9 < M.likeness(M.fingerprint(base), M.fingerprint(new)) < 1
    assert M.likeness(M.fingerprint(base), M.fingerprint(b"Other words. Nothing alike!")) == 0
    assert M.likeness(M.fingerprint(b""), M.fingerprint(b"")) == 1 and M.likeness(M.fingerprint(b""), M.fingerprint(b"a")) == 0


def _expect(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (key, text) in enumerate(rows):
        a, b = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(a) // 4
        edited = a[:len(a) - k] + b[:k]
        fa, fe, fb = (M.fingerprint(x.encode()) for x in (a, edited, b))
        out.append((str(key), len(a), hashlib.sha256(edited.encode()).hexdigest(), fa, fe,
                    round(M.likeness(fa, fe), 9), round(M.likeness(fa, fb), 9)))
    return sorted(out)


def _got(df):
    return sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"],
                   round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect())


def test_report_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert _got(Q.op7_fingerprints(spark, SF_SMALL)) == _expect(rows)
    near = Q.op7_fingerprints(spark, SF_SMALL).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert near[0] > 0.6 and near[1] < 0.2


def test_edges(spark):
    rows = [(5, "a. " * 40_000), (5, "short"), (7, None), (9, ""), (9, ""), (None, "ünïcode 😀 text here"), (-3, "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fingerprint string")
    assert _got(M.edits_report(df)) == _expect(rows)
    assert _got(M.edits_report(df.where("doc_id = -3"))) == _expect([(-3, "x")])
    assert M.edits_report(df.limit(0)).count() == 0


def test_likeness_and_edits_come_from_whole_trees(spark):
    a = "".join(f"Clause number {i} of one text. " for i in range(4000))
    b = "".join(f"Sentence {i} of another one! " for i in range(4000)) + a[:310]
    got = {r["doc_id"]: r for r in M.edits_report(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}
    for text, other, r in ((a, b, got[1]), (b, a, got[2])):
        k = len(text) // 4
        edited = (text[:len(text) - k] + other[:k]).encode()
        leaves = [{x for line in M.LINE.findall(t) for x in M.LEAF.findall(line)} for t in (text.encode(), edited, other.encode())]
        for name, n in (("near_edited", 1), ("near_next", 2)):
            dice = 2 * len(leaves[0] & leaves[n]) / (len(leaves[0]) + len(leaves[n]))
            assert dice > 0 and abs(r[name] - dice) < 1e-12
        assert [tuple(e) for e in r["edits"]] == M.locate_edits(text.encode(), edited) != []
        assert r["sections"] == [s.digest.hex() for s in M.tree(text.encode()).children]
