"""Shards by a hierarchical weighted hash tree (operator 3, law ``key``).

The tree has regions, racks and shards; an inner node weighs as much as its
subtree. A row descends from the root: at each level every child of the node
it has reached draws an exponential variate, ``-ln(u) / weight`` with ``u``
hashed from the row's key and the child's name, and the least draw wins. A row
draws only among the children on its own way, so with three regions of two
racks of four shards that is 3 + 2 + 4 draws.

A child's draw depends on its own weight alone. A changed weight therefore
moves rows only into or out of the nodes above it, whose weights change with
it; rows that stay outside the changed region do not move. A new shard is a
region of its own (``grown``): all old nodes keep their weights, so it takes
rows only into itself. A new shard inside an old rack would take more rows to
that rack and deal them over the rack's old shards too, which the law forbids.

Defined results: a null key hashes as one value of its own, a null text has
size 8 and checksum 0, repeated rows share a shard and get slots of their own;
an empty table gives an empty result.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.common import gapless_rank


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(n_shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    """``n_shards`` equal shards, numbered along racks and regions."""
    return [Shard(s // (per_rack * racks_per_region), s // per_rack, s) for s in range(n_shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, a region of its own."""
    return [*tree, Shard(max(s.region for s in tree) + 1, max(s.rack for s in tree) + 1,
                         max(s.shard for s in tree) + 1, weight)]


def draw(key: Column, name: Column, weight: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(name, key), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2 ** 53))) / weight


def choose(key: Column, children: list[list[tuple[str, float]]], parent: Column) -> Column:
    """Number, among its parent's children, of the child with the least draw
    (ties: the least number). ``children``: names and weights by parent."""
    def of_parent(values: list) -> Column:
        return F.get(F.array(*map(F.lit, values)), parent)
    drawn = []
    for j in range(max(map(len, children))):
        held = [c[j] if j < len(c) else ("", 0.0) for c in children]
        weight = of_parent([w for _, w in held])
        d = F.when(weight > 0, draw(key, of_parent([n for n, _ in held]), weight)).otherwise(float("inf"))
        drawn.append(F.struct(d.alias("d"), F.lit(j).alias("n")))
    return F.array_min(F.array(*drawn)).getField("n")


def place(df: DataFrame, key: Column, trees: dict[str, list[Shard]]) -> DataFrame:
    """Adds one shard column per named tree."""
    columns, step = df.columns, df.withColumn("__key", F.coalesce(key.cast("string"), F.lit("\0")))
    for out, tree in trees.items():
        regions = sorted({s.region for s in tree})
        racks = [sorted({s.rack for s in tree if s.region == g}) for g in regions]
        every_rack = [r for own in racks for r in own]
        shards = [sorted((s for s in tree if s.rack == r), key=lambda s: s.shard) for r in every_rack]
        total = lambda keep: float(sum(s.weight for s in tree if keep(s)))
        first = [sum(map(len, racks[:g])) for g in range(len(regions))]
        step = step.withColumn("__region", choose(F.col("__key"), [[
            (f"region-{g}", total(lambda s: s.region == g)) for g in regions]], F.lit(0)))
        step = step.withColumn("__rack", F.get(F.array(*map(F.lit, first)), F.col("__region")) + choose(
            F.col("__key"), [[(f"rack-{r}", total(lambda s: s.rack == r)) for r in own] for own in racks],
            F.col("__region")))
        width = max(map(len, shards))
        number = F.array(*[F.lit(own[j].shard if j < len(own) else -1) for own in shards for j in range(width)])
        step = step.withColumn(out, F.get(number, F.col("__rack") * width + choose(
            F.col("__key"), [[(f"shard-{s.shard}", float(s.weight)) for s in own] for own in shards],
            F.col("__rack"))))
    return step.select(*columns, *trees)


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    placed = place(rows, F.col("doc_id"),
                   {"shard": layout(n_shards), "grown_shard": grown(layout(n_shards))})
    return gapless_rank(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
