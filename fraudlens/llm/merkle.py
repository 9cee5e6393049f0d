"""Merkle manifest of a dataset in van Emde Boas blocks (operator 12).

Every row is a leaf, each group a tree of fan-out 3 over its leaves in key
order, and the groups' roots, in group order, are the leaves of one more tree.
A tree is cut into aligned subtrees of ``HEIGHT`` levels above their leaves. A
task builds one subtree (at most ``FANOUT ** HEIGHT`` rows, however large a
group is) and stores it as one binary value in van Emde Boas order: the levels
are split at half height, the upper half comes first, then the lower subtrees
from left to right, each stored in the same way. ``address`` gives a node's
place by arithmetic alone, for construction and for siblings alike. The roots
of the subtrees are the leaves of the next round, so a group of n rows takes
log(n) / log(FANOUT ** HEIGHT) rounds. On the way back a subtree receives the
siblings above its root and hands each of its leaves its own.

Only digests are shuffled. Texts are read once, by the leaf hash.

Defined results: a null field is hashed as ``-`` and a null group is a group
of its own, the first one; null keys come first in their group and are never
changed by the registered query's delivery; rows of one key are separate
leaves, ordered by their hashes; the only leaf of a group is its root, and the
only group's root is the root; an empty table gives an empty result; columns
that are not fields are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.common import gapless_rank, ship, written

ship(__name__)

FANOUT = 3
#: Levels of a stored subtree above its leaves: 2,187 leaves, 105 kB.
HEIGHT = 7
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ------------------------------------------------------------------- layout
def nodes(levels: int) -> int:
    """Nodes of a full tree of that many levels."""
    return (FANOUT ** levels - 1) // (FANOUT - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of one depth (the root's is 0) in the
    van Emde Boas order of a full tree."""
    if levels == 1:
        return np.zeros_like(index)
    lower = levels // 2
    upper = levels - lower
    if depth < upper:
        return address(upper, depth, index)
    tree, inside = np.divmod(index, FANOUT ** (depth - upper))
    return nodes(upper) + tree * nodes(lower) + address(lower, depth - upper, inside)


@lru_cache(maxsize=None)
def places(height: int) -> list[list[int]]:
    """``places(h)[l][i]``: the place of node i, l levels above the leaves."""
    return [address(height + 1, height - level, np.arange(FANOUT ** (height - level))).tolist()
            for level in range(height + 1)]


def digest(parts: list[bytes]) -> bytes:
    """Hash of digests as concatenated lower-case hex text."""
    return hashlib.sha256("".join(map(bytes.hex, parts)).encode()).digest()


class Subtree:
    """One stored subtree: its leaf count, its height and its nodes."""

    def __init__(self, count: int, height: int, store):
        self.count, self.height, self.store = count, height, store

    def width(self, level: int) -> int:
        return -(-self.count // FANOUT ** level)

    def get(self, level: int, i: int) -> bytes:
        at = places(self.height)[level][i] * DIGEST
        return bytes(self.store[at:at + DIGEST])

    def put(self, level: int, i: int, value: bytes) -> None:
        at = places(self.height)[level][i] * DIGEST
        self.store[at:at + DIGEST] = value

    def run(self, level: int, i: int) -> range:
        """The siblings of node i, itself included."""
        first = i - i % FANOUT
        return range(first, min(first + FANOUT, self.width(level)))

    @classmethod
    def build(cls, leaves: list[bytes], height: int) -> "Subtree":
        tree = cls(len(leaves), height, bytearray(nodes(height + 1) * DIGEST))
        for i, leaf in enumerate(leaves):
            tree.put(0, i, leaf)
        for level in range(height):
            for i in range(tree.width(level + 1)):
                below = [tree.get(level, k) for k in tree.run(level, FANOUT * i)]
                tree.put(level + 1, i, digest(below))
        return tree

    def siblings(self, i: int) -> list[tuple[list[bytes], list[bytes]]]:
        """For each level from leaf i up, the siblings before and after."""
        out = []
        for level in range(self.height):
            run = self.run(level, i)
            out.append(([self.get(level, k) for k in run if k < i],
                        [self.get(level, k) for k in run if k > i]))
            i //= FANOUT
        return out


def own_height(count: int) -> int:
    """Levels until one node remains."""
    height = 0
    while count > 1:
        count, height = -(-count // FANOUT), height + 1
    return height


def block_height(block: int, count: int) -> int:
    """A subtree that is a whole tree ends at its root; one of several (a
    later one, or a full first one) has all its levels."""
    return own_height(count) if block == 0 else HEIGHT


# -------------------------------------------------------------------- paths
def pack(path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    return b"".join(bytes([len(before), len(after)]) + b"".join(before + after) for before, after in path)


def unpack(blob: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    out, at = [], 0
    while at < len(blob):
        b, a = blob[at], blob[at + 1]
        parts = [blob[k:k + DIGEST] for k in range(at + 2, at + 2 + (a + b) * DIGEST, DIGEST)]
        out.append((parts[:b], parts[b:]))
        at += 2 + (a + b) * DIGEST
    return out


def fold(leaf: bytes, path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for before, after in path:
        leaf = digest([*before, leaf, *after])
    return leaf


def proof(path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    return digest([x for before, after in path for x in before + after])


# -------------------------------------------------------------- Spark rounds
BLOCK = "g string, block long, n int, store binary, root binary"


def _build(table: pa.Table) -> pa.Table:
    """One subtree from its leaves; further columns are kept in leaf order."""
    table = table.sort_by("i")
    block, n = table["block"][0].as_py(), len(table)
    tree = Subtree.build(table["digest"].to_pylist(), block_height(block, n))
    row = {"g": [table["g"][0].as_py()], "block": [block], "n": [n], "store": [bytes(tree.store)],
           "root": [tree.get(tree.height, 0)]}
    for c in ("id", "seen"):
        if c in table.column_names:
            row[c] = [table[c].to_pylist()]
    types = {"n": pa.int32(), "store": pa.binary(), "root": pa.binary(), "g": pa.string(), "block": pa.int64(),
             "id": pa.list_(pa.int64()), "seen": pa.list_(pa.binary())}
    return pa.table({c: pa.array(v, types[c]) for c, v in row.items()})


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, i, path) of every leaf of the subtrees, whose own paths are given."""
    for batch in batches:
        for row in batch.to_pylist():
            tree = Subtree(row["n"], block_height(row["block"], row["n"]), row["store"])
            above = row["path"] or b""
            first = row["block"] * FANOUT ** HEIGHT
            yield pa.record_batch([pa.array([row["g"]] * tree.count, pa.string()),
                                   pa.array(range(first, first + tree.count), pa.int64()),
                                   pa.array([pack(tree.siblings(i)) + above for i in range(tree.count)],
                                            pa.binary())], ["g", "i", "path"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, id, leaf, proof, folded) of every row of the lowest subtrees."""
    for batch in batches:
        for row in batch.to_pylist():
            tree = Subtree(row["n"], block_height(row["block"], row["n"]), row["store"])
            above = unpack(row["path"] or b"")
            paths = [tree.siblings(i) + above for i in range(tree.count)]
            yield pa.record_batch([
                pa.array([row["g"]] * tree.count, pa.string()), pa.array(row["id"], pa.int64()),
                pa.array([tree.get(0, i).hex() for i in range(tree.count)]),
                pa.array([proof(p).hex() for p in paths]),
                pa.array([fold(seen, p).hex() for seen, p in zip(row["seen"], paths)]),
            ], ["g", "id", "leaf", "proof", "folded"])


def grow(leaves: DataFrame) -> list[DataFrame]:
    """Tables of stored subtrees from (g, i, digest, ...), lowest first, until
    each tree is one subtree; ``root`` of the last is the tree's root."""
    out, cut = [], FANOUT ** HEIGHT
    while True:
        extra = ", id array<bigint>, seen array<binary>" if "seen" in leaves.columns else ""
        blocks = written(leaves.withColumn("block", F.floor(F.col("i") / cut))
                         .groupBy("g", "block").applyInArrow(_build, BLOCK + extra), "subtrees")
        out.append(blocks)
        if not blocks.agg(F.max("block")).first()[0]:
            return out
        leaves = blocks.select("g", F.col("block").alias("i"), F.col("root").alias("digest"))


def hand_down(blocks: list[DataFrame], paths: DataFrame) -> DataFrame:
    """(g, block, path) of the lowest subtrees, from (g, path) of the roots."""
    paths = paths.select("g", F.lit(0).cast("long").alias("block"), "path")
    for table in reversed(blocks[1:]):
        found = table.select("g", "block", "n", "store").join(paths, ["g", "block"], "left")
        paths = (found.mapInArrow(_handed_down, "g string, i long, path binary")
                 .withColumnRenamed("i", "block"))
    return paths


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of the fields: each ``-`` if null, else byte count, colon, value."""
    coded = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"),
                                 c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*coded).cast("binary"), 256))


def manifest(docs: DataFrame, delivered: dict[str, Column] | None = None, key: str = "doc_id",
             group: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per document: key, leaf, subroot, root, proof_sha256, and what
    the delivered row (its fields replaced as ``delivered`` says) folds to:
    folded_root and verified."""
    delivered = delivered or {}
    whole = [F.col(c) for c in fields]
    other = [delivered.get(c, F.col(c)) for c in fields]
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = written(docs.select(named.alias("g"), F.col(key).cast("long").alias("id"),
                                 leaf_hash(whole).alias("digest"), leaf_hash(other).alias("seen")), "leaves")
    placed = gapless_rank(leaves, ["g"], ["id", "digest"], "i")
    groups = grow(placed.select("g", "i", "id", "digest", "seen"))

    subroots = written(groups[-1].select("g", F.col("root").alias("digest")), "subroots")
    order = gapless_rank(subroots, [], ["g"], "i").select("g", "i", "digest")
    top = grow(order.select(F.lit("").alias("g"), "i", "digest"))
    found = top[-1].select("root").first()
    root = found[0].hex() if found else None
    spark = docs.sparkSession
    start = spark.createDataFrame([("", b"")], "g string, path binary")
    above = (top[0].select("g", "block", "n", "store").join(hand_down(top, start), ["g", "block"], "left")
             .mapInArrow(_handed_down, "g string, i long, path binary").select("i", "path"))
    roots = written(order.join(above, "i").select("g", "digest", "path"), "subroots")

    rows = (groups[0].join(hand_down(groups, roots.select("g", "path")), ["g", "block"], "left")
            .select("g", "block", "n", "store", "id", "seen", "path")
            .mapInArrow(_checked, "g string, id long, leaf string, proof string, folded string"))
    return (rows.join(roots.select("g", F.lower(F.hex("digest")).alias("subroot")), "g")
            .select(F.col("id").alias(key), "leaf", "subroot", F.lit(root).alias("root"),
                    F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"),
                    (F.col("folded") == F.lit(root)).alias("verified")))
