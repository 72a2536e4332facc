import random
from collections import defaultdict

import numpy as np
import pytest

from loanframe.llm import neardup as N
from loanframe.llm import queries as Q
from loanframe.llm.common import components, maybe_among, word_hashes
from tests.conftest import SF_SMALL


def _sets(rows, width):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        out[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    return out


def _brute(rows, width, num, den):
    sets = _sets(rows, width)
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = defaultdict(int)
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                common[min(ids[a], ids[b]), max(ids[a], ids[b])] += 1
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for (a, b), c in common.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def _got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def _copies(n_base=12, size=120, seed=1):
    """Chains, stars and crowds of near copies around random texts."""
    rnd = random.Random(seed)
    word = lambda: "w%d" % rnd.randint(0, 5000)
    rows, i = [], 0
    for _ in range(n_base):
        base = [word() for _ in range(size)]
        cur = list(base)
        for _ in range(rnd.choice([1, 3, 25])):
            mode = rnd.random()
            cur = list(cur if mode < 0.5 else base)
            for _ in range(rnd.randint(0, 4)):
                cur[rnd.randrange(size)] = word()
            rows.append((i, " ".join(cur)))
            i += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,num", [(3, 85), (5, 80)])
def test_matches_brute_force_on_copies(spark, monkeypatch, width, num):
    monkeypatch.setattr(N, "BLOCK", 7)                      # many blocks a bucket
    rows = _copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(N.near_duplicates(df, width=width, num=num)) == _brute(rows, width, num, 100)


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = _brute([(r["doc_id"], r["text"]) for r in docs], 3, 85, 100)
    assert _got(Q.op1_near_dedup(spark, SF_SMALL)) == want


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(5, "a b", 0), (3, "A  b\n", 0), (7, "a", 0), (8, "", 0), (9, None, 0), (10, " \t", 0), (None, "a b", 0),
            (20, long, 0), (21, long + " tail", 0), (4, "b a", 0), (3, "A  b\n", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    out = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(df).collect())
    assert out == sorted([("5", 1, 3, False), ("3", 1, 3, True), ("3", 1, 3, True), ("7", 1, 7, True), ("8", 0, 8, True),
                          ("9", 0, 9, True), ("10", 0, 10, True), ("None", 1, None, True), ("20", 29_996, 20, True),
                          ("21", 29_997, 20, False), ("4", 1, 4, True)], key=lambda x: x)
    kept = sorted(str(r["doc_id"]) for r in N.keep_one(df).collect())
    assert kept == sorted(["3", "7", "8", "9", "10", "None", "20", "4"])
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_signature_estimates_with_low_variance():
    rnd = np.random.default_rng(0)
    err = []
    for _ in range(200):
        x = rnd.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = np.unique(x[:250]), np.unique(x[50:])
        err.append((N.superminhash(a) == N.superminhash(b)).mean() - 200 / 300)
    assert abs(np.mean(err)) < 0.015 and np.std(err) < (2 / 9 / 100) ** 0.5


def test_word_hashes_follow_words():
    a = word_hashes(b" the cat\tthe  dog\n")
    assert len(a) == 4 and a[0] == a[2] and len(set(a.tolist())) == 3
    assert len(word_hashes(b"")) == 0 and len(word_hashes(b" \n")) == 0


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    df = spark.createDataFrame(path + star + [(7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_filter_loses_no_key_and_stops_most_others(spark):
    keys = spark.range(0, 5000, 7).toDF("k")
    df = spark.range(100_000).toDF("doc_id")
    got = {r["doc_id"] for r in maybe_among(df, "doc_id", keys, bits=1 << 16).collect()}
    assert set(range(0, 5000, 7)) <= got and len(got) < 3500
    assert len({r["doc_id"] for r in maybe_among(df.limit(50), "doc_id", keys.limit(0)).collect()}) == 0


def test_repeated_ids_are_different_documents(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(3, None), (3, a), (3, b), (3, b), (3, b + " c"), (2, a), (None, a), (None, a), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in N.keep_one(df).collect())))
    left = [(3, None), (2, a), (None, a), (None, a), (None, None)]
    assert [x for x in got if "b1 " not in x] == sorted(map(str, left))
    assert sum("b1 " in x for x in got) == 1 and len(got) == len(left) + 1
