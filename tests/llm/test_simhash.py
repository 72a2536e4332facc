import random

import numpy as np
import xxhash

from loanframe.llm import queries as Q
from loanframe.llm import simhash as S
from tests.conftest import SF_SMALL


def _print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps):
    """Smallest place reachable, from all pairs."""
    fps = np.array(fps, dtype=np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def _crowd(rnd, n):
    """Random fingerprints, chains and crowds around some, and a crowd that shares most of its bits."""
    out = [rnd.getrandbits(64) for _ in range(n)]
    for base in out[:3]:
        for _ in range(n // 4):
            x = base
            for _ in range(rnd.choice([1, 2, 2, 3, 3, 4])):
                x ^= 1 << rnd.randrange(64)
            out.append(x)
    x = rnd.getrandbits(64)
    for _ in range(40):
        for _ in range(3):
            x ^= 1 << rnd.randrange(64)
        out.append(x)
    out += [x ^ sum(1 << b for b in rnd.sample(range(20), 6)) for _ in range(n)] + [0, 0, 7, 15]
    return out


def _linked(spark, fps, parts):
    rows = [(int(np.uint64(f).view(np.int64)),) for f in set(fps)]
    classes = spark.createDataFrame(rows, "fp long").selectExpr("fp", "fp AS rep", "1L AS docs")
    parts = S.partition_bits(classes) if parts is None else parts
    members = S._groups(classes, parts, 3)
    merged = S.components(S._links(members, parts, 3)).toPandas()
    whole = dict(zip(merged["node"], merged["root"]))
    return {r["fp"]: whole.get(r["root"], r["root"]) for r in members.collect()}


def test_links_match_all_pairs(spark, monkeypatch):
    rnd = random.Random(2)
    fps = _crowd(rnd, 250)
    distinct = sorted(set(fps))
    want = {}
    for f, c in zip(distinct, _components(distinct)):
        want.setdefault(c, set()).add(int(np.uint64(f).view(np.int64)))
    want = {frozenset(x) for x in want.values()}
    for blocks in ((4096, 65_536, 1 << 20), (7, 5, 64)):
        for name, size in zip(("DATA_BLOCK", "PROBE_BLOCK", "PAIRS"), blocks):
            monkeypatch.setattr(S, name, size)
        got = {}
        for f, root in _linked(spark, fps, None).items():
            got.setdefault(root, set()).add(f)
        assert {frozenset(x) for x in got.values()} == want
    assert max(map(len, want)) > 40 and len(want) > 100


def test_allocation_is_complete_and_cheapest():
    rnd = np.random.default_rng(5)
    counts = rnd.integers(0, 3, size=(S.PARTS, 1 << S.WIDTH))
    counts[0, :64] = 500_000                                    # a crowded partition
    within = S._within(counts, 3)
    value, masks = 37, S._masks(3)
    assert all(within[1, t, value] == counts[1][value ^ masks[t]].sum() for t in range(4))
    values = np.stack([rnd.integers(0, 64, 50), *(rnd.integers(0, 1 << 16, 50) for _ in range(3))], axis=1)
    units = S.allocate(values, within, 3)
    assert (units.sum(axis=1) == 4).all() and (units[:, 0] == 0).all()        # the crowd isn't probed
    cost = lambda v, u: sum(within[p, x - 1, v[p]] + S.PROBE_COST * len(masks[x - 1]) for p, x in enumerate(u) if x)
    every = [(a, b, c, 4 - a - b - c) for a in range(5) for b in range(5 - a) for c in range(5 - a - b)]
    assert all(cost(v, u) == min(cost(v, e) for e in every) for v, u in zip(values, units))


def test_correlated_bits_share_a_partition(spark):
    rnd = random.Random(6)
    same = rnd.sample(range(64), 16)
    rows = []
    for _ in range(300):
        x = rnd.getrandbits(64)
        for b in same:
            x = x | 1 << b if x >> same[0] & 1 else x & ~(1 << b)
        rows.append((int(np.uint64(x).view(np.int64)),))
    parts = S.partition_bits(spark.createDataFrame(rows, "fp long"))
    assert sorted(same) in parts.tolist() and sorted(parts.ravel().tolist()) == list(range(64))


def _got(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def _brute(rows):
    fps = [_print(t) for _, t in rows]
    known = [i for i, (d, _) in enumerate(rows) if d is not None]
    comp = _components([fps[i] for i in known])
    least = {}
    for i, c in zip(known, comp):
        least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    where = dict(zip(known, comp))
    return sorted(((d, f"{fps[i]:016x}", least[where[i]] if i in where else None) for i, (d, _) in enumerate(rows)), key=str)


def test_fingerprint_in_chunks(monkeypatch):
    text = "Ab c " + " ".join(f"w{i % 7}x{i % 11}" for i in range(500))
    monkeypatch.setattr(S, "CHUNK", 11)
    assert all(S.fingerprint(t.encode()) == _print(t) for t in (text, "a", "a b", "a b c", "", text[:40]))


def test_edges(spark):
    text = " ".join(f"w{i % 97}" for i in range(20_000))
    docs = [(9, None, 1), (8, "", 1), (7, " \t\n", 1), (6, "ONE two", 1), (5, "one\x0btwo", 1), (5, "three é words Here", 2),
            (None, "one two", 3), (None, None, 3), (4, text, 1), (3, text + " end", 1), (2, "a\x1cb c d e", 1), (2, "a\x1cb c d e", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, fp int")
    got = _got(S.near_duplicates(d))
    assert got == _brute([r[:2] for r in docs])
    assert (9, "0" * 16, 7) in got and (4, got[4][1], 3) in [(r[0], got[4][1], r[2]) for r in got]
    assert S.near_duplicates(d.limit(0)).count() == 0


def test_documents_match_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = _got(Q.op13_simhash_dedup(spark, SF_SMALL))
    assert got == _brute(rows) and any(d != c for d, _, c in got)
