import math

import pytest
import xxhash

from loanframe.llm import sharding as S


def _draw(key, label, weight):
    h = xxhash.xxh64_intdigest(label.encode(), seed=xxhash.xxh64_intdigest(key.encode(), seed=42))
    return -math.log(((h & ((1 << 52) - 1)) + 0.5) / (1 << 52)) / weight


def _descend(key, leaves):
    def pick(options):
        return options[0][0] if len(options) == 1 else min((_draw(key, lab, w), n) for n, lab, w in options)[1]
    regions = sorted({x.region for x in leaves})
    r = pick([(i, f"r{i}", sum(x.weight for x in leaves if x.region == i)) for i in regions])
    inside = [x for x in leaves if x.region == r]
    q = pick([(i, f"r{r}/q{i}", sum(x.weight for x in inside if x.rack == i)) for i in sorted({x.rack for x in inside})])
    return pick([(x.shard, f"r{r}/q{q}/s{x.shard}", x.weight) for x in inside if x.rack == q])


def test_matches_brute_force_descent(spark):
    leaves = S.tree_for(25) + [S.Leaf(7, 0, 99, 3.5), S.Leaf(7, 1, 98, 0.0)]
    df = spark.range(700).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r["shard"] for r in S.place(df, "doc_id", leaves).collect()}
    live = [x for x in leaves if x.weight > 0]
    assert got == {i: _descend(str(i), live) for i in range(700)}


def test_weights_balance_and_confine_movement(spark):
    df = spark.range(40_000).withColumnRenamed("id", "doc_id")
    old = S.tree_for(24)
    new = [S.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in old]
    a = S.place(df, "doc_id", old).withColumnRenamed("shard", "a").drop("region", "rack")
    both = S.place(a, "doc_id", new).select("a", "shard").toPandas()
    counts = both.a.value_counts()
    assert len(counts) == 24 and counts.min() > 0.85 * 40_000 / 24 and counts.max() < 1.15 * 40_000 / 24
    assert 0.09 < (both.shard == 5).mean() < 0.145           # weight 3 of 26
    moved = both[both.a != both.shard]
    inside = {x.shard for x in old if x.region == 0}
    assert not (moved.a.isin(inside) & ~moved.shard.isin(inside)).any()   # none leaves the region that grew
    rack = {x.shard for x in old if x.region == 0 and x.rack == 1}
    stay = moved[moved.a.isin(inside)]
    assert stay.shard.isin(rack).all()


def test_contract(spark):
    rows = [(i, ["a", "é", "", None, "x" * 5000][i % 5], "s") for i in range(3000)] + [(None, "n", "s"), (7, "é", "s"), (7, "é", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string")
    out = S.shard_rows(df)
    out = S.with_slots(out.drop("slot"), "doc_id", rows_per_group=50).toPandas()
    assert len(out) == len(rows) and out.shard.between(0, 23).all()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    grown = out[out.shard != out.grown_shard]
    assert (grown.grown_shard == 24).all() and 0 < len(grown) < len(out) / 10
    assert set(out["size"]) == {8, 9, 10, 5008}
    assert out[out["size"] == 8].text_crc32.eq(0).all()
    assert out[out.doc_id == 7].shard.nunique() == 1


def test_empty_and_errors(spark):
    assert S.shard_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        S.tree_for(0)
