"""MinHash near-duplicates by a signature-coordinate inverted join (operator 1).

Each document's set of word shingles gets a signature of ``COORDINATES``
minima. Texts with equal sets are one node from here on. A node is posted
under each (coordinate, value) of its signature; two nodes whose similarity
reaches the limit agree in at least ``least_matches`` coordinates but for a
chance below 1e-7, so:

* skip: values posted once can match nothing and are dropped;
* prefix: with its values ordered by how often they are posted, a node needs
  to be met only under its COORDINATES - least_matches + 1 rarest ones, since
  two nodes that agree in enough coordinates share one of those. Values
  posted once come first and use up places, so most nodes end here.

Lists of one value would emit a pair many times over, and a list of thousands
of near copies all its pairs. Instead, lists with the same least member (by
hash) are merged into one group, and a group is dealt into cells of about
``BLOCK`` members or two such blocks, so no task holds a group. Within a cell
collisions are counted on the signatures, pairs with enough of them are
confirmed on the full sets, pairs that are already connected are skipped, and
only links that join two parts leave the cell: fewer rows than members.

A group of several blocks goes through rounds. In each, a block meets itself
and the group's pivots (some ``PIVOTS`` members drawn anew and the member with
most links so far); links are contracted; a group that is one part by then is
finished, and of the others only the members outside the largest part are
dealt again. Once that no longer halves them, or one block of a group is left,
the pairs still apart are compared in full: blocks of the rest with each other
and with those of the largest part. Near copies of one text are joined by the
rounds, so that their set rows grow with the members; texts that collide but
are no copies are compared pair by pair.

Components come from contracting links in Spark, each round written to the
shared folder. No step drops or caps documents, lists or candidates.

Sets are of 64-bit shingle hashes and equal sets are told by a 128-bit digest.

Defined results: null, empty and blank texts have no shingles and link to
nothing; a text shorter than a shingle has its whole word sequence as one;
repeated rows and equal texts share a component; a null id is smaller than
none (a component's id is its least id that is not null, or null); extra
columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.common import LEAST_ID, UPPER, identity, ship, written

ship(__name__)

COORDINATES = 64
BLOCK = 512
PIVOTS = 64
#: Chance that a pair exactly at the limit shows too few matches.
MISS = 1e-7
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_RANDOM = np.random.default_rng(20240229)
MULTIPLIERS = _RANDOM.integers(1, 2 ** 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _RANDOM.integers(0, 2 ** 63, COORDINATES, dtype=np.uint64)


def least_matches(similarity: float, coordinates: int = COORDINATES) -> int:
    """The most matches that a pair at the limit reaches but for ``MISS``."""
    below = 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * similarity ** t * (1 - similarity) ** (coordinates - t)
        if below > MISS:
            return max(t, 1)
    return coordinates


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    split = (text or "").encode().translate(LOWER).split()   # at the six ASCII white-space bytes
    if not split:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    return np.unique(out ^ (out >> np.uint64(32)))


def signature(items: np.ndarray, chunk: int = 4096) -> np.ndarray:
    least = np.full(COORDINATES, 2 ** 32 - 1, np.uint64)
    for i in range(0, len(items), chunk):
        drawn = ((items[i:i + chunk, None] ^ MASKS) * MULTIPLIERS) >> np.uint64(32)
        np.minimum(least, drawn.min(0), out=least)
    return least.astype(np.uint32).view(np.int32)


def digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, th, n_shingles, node (null without shingles) and signature."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, nodes, signs = [], [], []
            for text in batch.column(2):
                items = shingles(text.as_py(), width)
                counts.append(len(items))
                nodes.append(digest(items) if len(items) else None)
                signs.append(signature(items).tolist() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(signs, pa.list_(pa.int32()))],
                ["doc_id", "th", "n_shingles", "node", "sign"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), identity(id_col, text_col)[1],
                       F.col(text_col).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, th long, n_shingles long, node binary, sign array<int>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, items, sign) as raw bytes."""
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for x in (shingles(t.as_py(), width) for t in batch.column(0)) if len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(x) for x in rows], pa.binary()),
                 pa.array([x.tobytes() for x in rows], pa.binary()),
                 pa.array([signature(x).tobytes() for x in rows], pa.binary())],
                ["node", "items", "sign"])

    return docs.select(F.col(text_col)).mapInArrow(collect, "node binary, items binary, sign binary")


def groups(nodes: DataFrame, matches: int) -> DataFrame:
    """(grp, nid): the merged lists that a node has to be compared in."""
    value = F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    key = F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(value)
    postings = nodes.select("nid", F.posexplode("sign").alias("c", "v")).select("nid", key.alias("key"))
    often = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = (postings.join(often, "key").groupBy("nid")
              .agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("by_rarity")))
    places = F.lit(COORDINATES - matches + 1 - COORDINATES) + F.size("by_rarity")
    prefix = (shared.where(places > 0)
              .select("nid", F.explode(F.slice("by_rarity", F.lit(1), places)).alias("x"))
              .select("nid", "x.key"))
    prefix = written(prefix, "prefix")
    lists = (prefix.groupBy("key").agg(F.min(F.struct(F.xxhash64("nid").alias("h"), "nid")).alias("least"),
                                       F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > 1).select("key", F.col("least.nid").alias("grp")))
    return prefix.join(lists, "key").select("grp", "nid").distinct()


def many_blocks(members: DataFrame) -> DataFrame:
    """(grp, n) of the groups of more than one block: a table of its own, so
    that joins with it are broadcast if it is small and can be split at a hot
    group if it is not."""
    return written(members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
                   .where(F.col("n") > BLOCK), "blocks")


def blocks(n) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def stars(rest: DataFrame, turn: int) -> DataFrame:
    """(grp, lo, hi, blk, nid, root): the members outside the largest part
    dealt to blocks, and pivots of the whole group to every block."""
    count = blocks(F.col("rest"))
    drawn = F.pmod(F.xxhash64("nid", "grp", F.lit(f"pivot {turn}")), F.ceil(F.col("n") / PIVOTS)) == 0
    pivot = drawn | F.col("nid").eqNullSafe(F.col("hub"))
    own = F.pmod(F.xxhash64("nid", "grp", F.lit(turn)), count).cast("int")
    at = F.when(pivot, F.sequence(F.lit(0), count - 1)).when(~F.col("inner"), F.array(own))
    return (rest.select("grp", "nid", "root", F.explode(at).alias("lo"))
            .select("grp", "lo", F.col("lo").alias("hi"), F.lit(0).alias("blk"), "nid", "root"))


def pairs(rest: DataFrame) -> DataFrame:
    """(grp, lo, hi, blk, nid, root): blocks of the members outside the largest
    part meet each other and the blocks of the largest part."""
    few, most = blocks(F.col("rest")), blocks(F.col("n") - F.col("rest"))
    draw = lambda count: F.pmod(F.xxhash64("nid", "grp"), count).cast("int")
    own = F.when(F.col("inner"), few + draw(most)).otherwise(draw(few))
    other = F.when(F.col("inner"), F.sequence(F.lit(0), few - 1)) \
             .otherwise(F.sequence(F.lit(0), few + most - 1))
    return (rest.select("grp", "nid", "root", own.alias("blk"), F.explode(other).alias("other"))
            .select("grp", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"),
                    "blk", "nid", "root"))


def apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(grp, nid, root, inner, n, rest): members of the groups that are not one
    part yet, whether they are in the group's largest part, and how many the
    group has in all and outside that part."""
    placed = written(members.join(roots, "nid", "left")
                     .select("grp", "nid", F.coalesce("root", "nid").alias("root")), "placed")
    parts = placed.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("n"))
    open_groups = (parts.groupBy("grp").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"))
                   .where(F.col("top.n") < F.col("n"))
                   .select("grp", "n", (F.col("n") - F.col("top.n")).alias("rest"),
                           F.col("top.root").alias("main")))
    return written(placed.join(written(open_groups, "open"), "grp")
                   .select("grp", "nid", "root", (F.col("root") == F.col("main")).alias("inner"),
                           "n", "rest"), "apart")


def hubs(links: DataFrame) -> DataFrame:
    """(grp, hub): the member with most links of a group."""
    ends = links.select("grp", F.explode(F.array("na", "nb")).alias("nid"))
    return (ends.groupBy("grp", "nid").agg(F.count(F.lit(1)).alias("n")).groupBy("grp")
            .agg(F.max(F.struct("n", "nid")).alias("top")).select("grp", F.col("top.nid").alias("hub")))


def linker(num: int, den: int, matches: int):
    """Task function: the links of a cell that join two of its parts, as roots
    of those parts (a, b) and as members (na, nb)."""
    def link(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["blk", "nid"], kind="stable")
        ids, blk, root = (cell[c].to_numpy() for c in ("nid", "blk", "root"))
        sign = np.frombuffer(b"".join(cell["sign"]), np.int32).reshape(len(ids), COORDINATES)
        sets = [np.frombuffer(x, np.uint64) for x in cell["items"]]
        sizes = np.array([len(x) for x in sets])
        across = cell["lo"].iat[0] != cell["hi"].iat[0]
        _, first, which = np.unique(root, return_index=True, return_inverse=True)
        part = first[which]                        # part of each member, by its least index
        a_out, b_out = [], []
        for a in range(len(ids) - 1):
            b = np.arange(a + 1, len(ids))
            b = b[part[b] != part[a]]
            if across:
                b = b[blk[b] != blk[a]]
            small, large = np.minimum(sizes[b], sizes[a]), np.maximum(sizes[b], sizes[a])
            b = b[den * small >= num * large]
            b = b[(sign[b] == sign[a]).sum(1) >= matches]
            if not len(b):
                continue
            flat = np.concatenate([sets[x] for x in b])
            at = np.minimum(np.searchsorted(sets[a], flat), len(sets[a]) - 1)
            starts = np.concatenate([[0], np.cumsum(sizes[b])[:-1]])
            both = np.add.reduceat((sets[a][at] == flat).astype(np.int64), starts)
            for x in b[den * both >= num * (sizes[b] + sizes[a] - both)]:
                if part[x] != part[a]:
                    a_out.append(a)
                    b_out.append(x)
                    lo, hi = sorted((part[a], part[x]))
                    part[part == hi] = lo
        one, two = np.array(a_out, np.int64), np.array(b_out, np.int64)
        return pd.DataFrame({"grp": np.full(len(one), cell["grp"].iat[0]),
                             "na": ids[one], "nb": ids[two],
                             "a": np.minimum(root[one], root[two]),
                             "b": np.maximum(root[one], root[two])})
    return link


def components(links: DataFrame) -> DataFrame:
    """(nid, root) of all linked nodes, by contraction: every node moves to
    its least neighbour's least neighbour, links follow, until none is left."""
    edges = written(links.select("a", "b").distinct(), "links")
    roots = written(edges.select(F.col("a").alias("nid")).union(edges.select("b")).distinct()
                    .select("nid", F.col("nid").alias("root")), "roots")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = written(both.groupBy(F.col("a").alias("from"))
                       .agg(F.least(F.min("b"), F.first("a")).alias("to")), "steps")
        twice = step.alias("s").join(step.alias("t"), F.col("s.to") == F.col("t.from")) \
                    .select(F.col("s.from").alias("from"), F.col("t.to").alias("to"))
        twice = written(twice, "steps")
        roots = written(roots.join(twice, F.col("root") == F.col("from"), "left")
                        .select("nid", F.coalesce("to", "root").alias("root")), "roots")
        a = twice.select(F.col("from").alias("a"), F.col("to").alias("ta"))
        b = twice.select(F.col("from").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(a, "a").join(b, "b").where("ta <> tb")
        edges = written(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
                        .distinct(), "links")
    return roots


def compared(cells: DataFrame, sets: DataFrame, num: int, den: int, matches: int) -> DataFrame:
    """(grp, na, nb, a, b): the links found in the cells."""
    found = (cells.join(sets, "nid").groupBy("grp", "lo", "hi")
             .applyInPandas(linker(num, den, matches), "grp long, na long, nb long, a long, b long"))
    return written(found, "found")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots of the nodes after links between their roots."""
    more = components(links).select(F.col("nid").alias("from"), F.col("root").alias("to"))
    known = roots.join(more, F.col("root") == F.col("from"), "left") \
                 .select("nid", F.coalesce("to", "root").alias("root"))
    fresh = more.join(roots, F.col("from") == F.col("nid"), "left_anti").select("from", "to")
    return written(known.union(fresh), "roots")


def linked_parts(members: DataFrame, sets: DataFrame, num: int, den: int, matches: int) -> DataFrame:
    """(nid, root) of all linked nodes, by the rounds of the module's text."""
    many = many_blocks(members)
    rest = (members.join(many, "grp", "left")
            .select("grp", "nid", F.col("nid").alias("root"), F.lit(False).alias("inner"),
                    F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("n", F.lit(1)).alias("rest"),
                    F.lit(None).cast("long").alias("hub")))
    links = compared(stars(rest, 0), sets, num, den, matches)
    roots = components(links)
    if many.isEmpty():
        return roots
    large = written(members.join(many.select("grp"), "grp"), "large")
    turn, before, top = 1, large.count(), hubs(links.join(many.select("grp"), "grp", "left_semi"))
    while True:
        rest = apart(large, roots)
        outside = rest.where(~F.col("inner"))
        left = outside.where(F.col("rest") > BLOCK).count()
        if left == 0 or turn > 1 and 2 * left > before:
            break
        star = stars(rest.where(F.col("rest") > BLOCK).join(written(top, "hubs"), "grp", "left"), turn)
        links = compared(star, sets, num, den, matches)
        roots, top = joined(roots, links), hubs(links)
        turn, before = turn + 1, left
    if outside.isEmpty():
        return roots
    return joined(roots, compared(pairs(rest), sets, num, den, matches))


def near_duplicates(docs: DataFrame, num: int = 4, den: int = 5, width: int = 5,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, kept and group
    per row; documents are linked if their shingle sets' similarity is at
    least num / den. ``group`` numbers the components (null: no shingles), also
    where repeated ids make component ids equal."""
    matches = least_matches(num / den)
    signed = written(signatures(docs, id_col, text_col, width), "signatures")
    nodes = (signed.where(F.col("node").isNotNull()).groupBy("node")
             .agg(F.min("doc_id").alias("first_id"), F.any_value("sign").alias("sign"))
             .withColumn("nid", F.monotonically_increasing_id()))
    nodes = written(nodes, "nodes")
    members = written(groups(nodes, matches), "members")

    least = lambda c: F.coalesce(c.cast("long"), F.lit(LEAST_ID))
    wanted = members.select("nid").distinct().join(nodes.drop("sign"), "nid")
    texts = docs.join(wanted.select(least(F.col("first_id")).alias("__first")).distinct(),
                      least(F.col(id_col)) == F.col("__first"), "left_semi")
    sets = (full_sets(texts, id_col, text_col, width).dropDuplicates(["node"])
            .join(wanted.select("node", "nid"), "node").select("nid", "items", "sign"))
    sets = written(sets, "sets")
    roots = linked_parts(members, sets, num, den, matches)

    named = roots.join(nodes.select("nid", "first_id"), "nid")
    component = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_node = (nodes.select("node", "nid", "first_id")
               .join(roots.join(component, "root"), "nid", "left")
               .select("node", F.coalesce("component_id", "first_id").alias("component_id"),
                       F.coalesce("root", "nid").alias("group")))
    columns = ["doc_id", "th", "n_shingles", "component_id", "group"]
    linked = signed.where(F.col("node").isNotNull()).drop("sign").join(by_node, "node").select(*columns)
    alone = (signed.where(F.col("node").isNull())
             .select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"),
                     F.lit(None).cast("long").alias("group")))
    return linked.unionByName(alone).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, num: int = 4, den: int = 5, width: int = 5,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns and one row of each component, of the least id (null
    ids last); rows without shingles all stay."""
    found = near_duplicates(docs, num, den, width, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    chosen = (found.where(F.col("group").isNotNull()).groupBy("group")
              .agg(F.min(order).alias("x"))
              .select(F.coalesce("x.doc_id", F.lit(LEAST_ID)).alias("d"), "x.th"))
    alone = (found.where(F.col("group").isNull())
             .select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("d"), "th").distinct())
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    keyed = docs.select(row, *identity(id_col, text_col))
    one = keyed.join(chosen, ["d", "th"], "left_semi").dropDuplicates(["d", "th"])
    return (one.unionByName(keyed.join(alone, ["d", "th"], "left_semi"))
            .select(*[F.col("__row")[c].alias(c) for c in docs.columns]))
