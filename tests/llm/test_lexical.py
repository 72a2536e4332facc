import math
import random
import re
from collections import Counter, defaultdict

import duckdb

from loanframe.llm import lexical as S
from loanframe.llm import queries as Q
from tests.conftest import SF_SMALL

SIGN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in SIGN.findall(text or "")]


def _brute(docs, items, k=10):
    """Every document against every item, from the definition."""
    bags = [Counter(_terms(t)) for _, t in docs]
    n, total = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        best = []
        for (doc, _), bag in zip(docs, bags):
            m = 25 + 75 * sum(bag.values()) * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t in _terms(text) if t in bag)
            if score > 0:
                best.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, b[3], -b[0]) for rank, b in enumerate(sorted(best)[:k], 1)]
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def _corpus(seed, n_docs, n_items):
    """Terms from very common to rare, many documents of equal score."""
    rnd = random.Random(seed)
    word = lambda: f"t{int(rnd.paretovariate(0.6)) % 400}"
    docs = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 3, 12, 12, 60])))) for i in range(n_docs)]
    docs += [(n_docs + i, docs[i % 7][1]) for i in range(n_docs // 3)]                    # copies: ties
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 2, 8, 30])))) for i in range(n_items)]
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    docs, items = _corpus(4, 400, 30)
    monkeypatch.setattr(S, "SLICE", 16)
    monkeypatch.setattr(S, "BUNDLE", 8)
    rnd = random.Random(1)
    rnd.shuffle(docs)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    want = _brute(docs, items)
    assert _got(S.search(d, i)) == want and len(want) > 200
    for owners in ((), (5500, 4500, 3500, 2500, 1500, 500)):
        monkeypatch.setattr(S, "OWNERS", owners)
        assert _got(S.search(d, i)) == want
    monkeypatch.undo()
    assert _got(S.search(d, i, k=3)) == _brute(docs, items, 3)


def test_accumulators_lose_only_what_can_not_win(spark, monkeypatch):
    """Documents leave on the way, and the results stay whole."""
    docs, items = _corpus(9, 600, 6)
    kept = defaultdict(int)
    before = S.stored

    def seen(df, name):
        out = before(df, name)
        if name == "lexical-carried":
            kept[len(kept)] = sum(len(r["place"]) for r in out.collect())
        return out
    monkeypatch.setattr(S, "stored", seen)
    monkeypatch.setattr(S, "OWNERS", (5000, 3500, 2000))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert _got(S.search(d, i)) == _brute(docs, items)
    pairs = sum(bool(set(_terms(t)) & set(_terms(x))) for _, t in docs for _, x in items)
    assert kept[2] < pairs


def test_edges(spark):
    docs = [(1, None, 5), (2, "", 5), (None, "Éa9 x", 5), (4, "éa9 X_x", 5), (4, "éa9 X_x", 5), (5, "y " * 100_000 + "Éa9", 5), (6, "...", 5)]
    items = [("a", "Éa9", 1), ("a", "Éa9", 1), (None, "x y", 1), ("n", None, 1), ("e", " ,", 1), ("u", "unknown", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, term int")
    i = spark.createDataFrame(items, "item_id string, text string, score int")
    assert _got(S.search(d, i)) == _brute([r[:2] for r in docs], [r[:2] for r in items])
    assert S.search(d.limit(0), i).count() == 0 and S.search(d, i.limit(0)).count() == 0
    assert S.search(d.where("doc_id < 3"), i).count() == 0


def test_documents_match_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    cur = con.execute(Q.OP12_SQL)
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in ("item_id", "rank", "doc_id", "score")) for r in cur.fetchall()), key=str)
    assert _got(Q.op12_lexical_search(spark, SF_SMALL)) == want and len(want) > 100
