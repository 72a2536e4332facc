"""Sharding by a hierarchical weighted hash tree (operator 8, DataFrame functions only).

A row's key descends region, rack and shard.  At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the key and the child's label; the
smallest draw wins, so a child gets rows in proportion to its weight.  A
child's draw depends on the key, its own label and its own weight alone:
when weights change below one subtree only rows that enter or leave that
subtree move.

The tree is laid out once for a base number of shards.  Every shard added
later hangs in a region of its own, so it takes rows only into itself: all
older nodes keep labels and weights, hence their draws.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree_for(shards: int, base: int = 24, racks_per_region: int = 3, shards_per_rack: int = 4) -> list[Leaf]:
    """Leaves for ``shards`` shards laid out for ``base``; later ones get regions of their own."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    per_region = racks_per_region * shards_per_rack
    regions = -(-base // per_region)
    leaves = [Leaf(s // per_region, s % per_region // shards_per_rack, s) for s in range(min(shards, base))]
    return leaves + [Leaf(regions + s - base, 0, s) for s in range(base, shards)]


def _draw(key: Column, label: str, weight: float) -> Column:
    """Exponential draw of rate ``weight`` from 52 bits of the hash of key and label."""
    bits = F.xxhash64(key, F.lit(label)).bitwiseAND(F.lit((1 << 52) - 1))
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _pick(key: Column, children: list[tuple[int, str, float]]) -> Column:
    """Number of the child with the smallest draw (ties: the smaller number)."""
    if len(children) == 1:
        return F.lit(children[0][0])
    draws = F.array(*[F.struct(_draw(key, label, w).alias("d"), F.lit(n).alias("n")) for n, label, w in children])
    return F.array_min(draws)["n"]


def _choose(selector: Column, options: dict[int, Column]) -> Column:
    out = None
    for k, v in sorted(options.items()):
        out = F.when(selector == k, v) if out is None else out.when(selector == k, v)
    return out


def place(df: DataFrame, key: str, tree: list[Leaf], shard: str = "shard",
          region: str = "region", rack: str = "rack") -> DataFrame:
    """Add region, rack and shard of every row (three projections, no shuffle).

    NULL keys are a key of their own.  Leaves of weight zero or less get no
    rows.  Rows with equal keys always share a shard.
    """
    leaves = [x for x in tree if x.weight > 0]
    if not leaves:
        raise ValueError("no shard has a positive weight")
    k = F.coalesce(F.col(key).cast("string"), F.lit("\u0000null"))
    by_region: dict[int, dict[int, list[Leaf]]] = {}
    for x in leaves:
        by_region.setdefault(x.region, {}).setdefault(x.rack, []).append(x)

    def weight(xs):
        return sum(x.weight for x in xs)

    regions = [(r, f"r{r}", sum(weight(xs) for xs in racks.values())) for r, racks in sorted(by_region.items())]
    rack_of = {r: _pick(k, [(q, f"r{r}/q{q}", weight(xs)) for q, xs in sorted(racks.items())])
               for r, racks in by_region.items()}
    shard_of = {r: _choose(F.col(rack), {q: _pick(k, [(x.shard, f"r{r}/q{q}/s{x.shard}", x.weight) for x in xs])
                                         for q, xs in racks.items()})
                for r, racks in by_region.items()}
    return (df.withColumn(region, _pick(k, regions))
            .withColumn(rack, _choose(F.col(region), rack_of))
            .withColumn(shard, _choose(F.col(region), shard_of).cast("int")))


def with_slots(df: DataFrame, key: str, shard: str = "shard", slot: str = "slot",
               rows_per_group: int = 8192) -> DataFrame:
    """Gapless numbers from 0 inside each shard, without one task per shard.

    Rows of a shard are dealt to hash groups of about ``rows_per_group`` rows,
    numbered inside their group, and shifted by the number of rows in the
    groups before it.  The table of group sizes has rows / rows_per_group
    rows; the join on it is Spark's choice.
    """
    groups = max(1, -(-df.select(key).count() // rows_per_group))
    g = df.withColumn("_grp", F.pmod(F.xxhash64(F.lit("slot"), F.col(key).cast("string")), F.lit(groups)))
    sizes = g.groupBy(shard, "_grp").agg(F.count("*").alias("_n"))
    before = sizes.select(shard, "_grp", F.expr(
        f"sum(_n) OVER (PARTITION BY {shard} ORDER BY _grp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - _n")
        .alias("_off"))
    rest = [c for c in df.columns if c not in (shard, key)]
    order = ", ".join([key, *[f"xxhash64({c})" for c in rest]])
    numbered = g.withColumn("_i", F.expr(f"row_number() OVER (PARTITION BY {shard}, _grp ORDER BY {order}) - 1"))
    return (numbered.join(before, [shard, "_grp"])
            .withColumn(slot, (F.col("_i") + F.col("_off")).cast("long")).drop("_i", "_off", "_grp"))


def shard_rows(docs: DataFrame, shards: int = 24, base: int = 24) -> DataFrame:
    """Place documents under the ``key`` law and say where one more shard would put them.

    Empty or NULL texts have size 8 and CRC 0; an empty table gives an empty
    result; repeated rows are placed alike and get slots of their own.  Other
    columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    rows = place(rows, "doc_id", tree_for(shards, base))
    rows = place(rows, "doc_id", tree_for(shards + 1, base), shard="grown_shard", region="_gr", rack="_gq")
    rows = with_slots(rows.drop("_gr", "_gq"), "doc_id")
    return rows.withColumn("law", F.lit("key")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")
