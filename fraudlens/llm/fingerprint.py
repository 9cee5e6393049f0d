"""Document fingerprints: a quartile digest of byte triplets (operator 7).

Byte triplets (three shapes inside a window of four bytes) are hashed into
``BUCKETS`` buckets. The digest holds the logarithm of the length, how the
quartiles of the bucket counts relate, and for every bucket which quartile
its count lies in (two bits). Two digests differ by the sum of their bucket
steps (opposite ends count double) and their length and quartile steps,
bounded by ``MOST``; likeness is 1 - difference / ``MOST``.

``next_likeness`` compares each document with the next one by id and with
itself after an edit. Texts are range-partitioned by id once and streamed in
order, so a task holds one Arrow batch; a partition's first and last
documents are set down and paired with their neighbours in a second small job
of at most two texts per partition.

Defined results: a null text is empty, the empty text has a digest of its own
(like only to itself and to texts of no triplets); texts under four bytes
have only a length; documents of equal ids follow each other by a hash of the
text, null ids come first; the only document is its own next; extra columns
are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fraudlens.llm.common import identity, ship, written

ship(__name__)

BUCKETS = 128
#: Difference at and above which two texts are not alike at all.
MOST = 300
#: Offsets of the bytes of each triplet.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_RANDOM = np.random.default_rng(7)
TABLES = _RANDOM.integers(0, BUCKETS, (len(SHAPES), 3, 256)).astype(np.uint8)


def digest(data: bytes) -> str:
    """Length step, quartile ratios and bucket quartiles, in hexadecimal."""
    raw, counts = np.frombuffer(data, np.uint8), np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(raw) - 3, 0), 1 << 20):          # bounded working memory
        part = raw[at:at + (1 << 20) + 3]
        n = len(part) - 3
        for shape, tables in zip(SHAPES, TABLES):
            hashed = tables[0][part[shape[0]:shape[0] + n]]
            for table, k in zip(tables[1:], shape[1:]):
                hashed = hashed ^ table[part[k:k + n]]
            counts += np.bincount(hashed, minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = (code[0::4] << 6 | code[1::4] << 4 | code[2::4] << 2 | code[3::4]).astype(np.uint8)
    length = min(int(8 * np.log2(len(raw))) + 1, 255) if len(raw) else 0
    ratio = (16 * q1 // (q3 + 1) << 4) | 16 * q2 // (q3 + 1)
    return bytes([length, min(ratio, 255), *packed.tolist()]).hex()


def difference(a: str, b: str) -> int:
    """0 (alike) to ``MOST``."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    length = abs(int(x[0]) - int(y[0]))
    ratios = abs((x[1] >> 4).astype(int) - (y[1] >> 4)) + abs((x[1] & 15).astype(int) - (y[1] & 15))
    steps = 0
    for shift in (6, 4, 2, 0):
        d = np.abs((x[2:] >> shift & 3).astype(np.int8) - (y[2:] >> shift & 3).astype(np.int8))
        steps += int(d.sum()) + 3 * int((d == 3).sum())
    return min(MOST, steps + max(0, length - 8) + int(ratios))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / MOST


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many code
    points of the following text's start."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare(doc, text: str, own: str, following: str, theirs: str) -> dict:
    changed = edited(text, following).encode()
    after = digest(changed)
    return {"doc_id": doc, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed).hexdigest(),
            "fingerprint": own, "edited_fingerprint": after,
            "near_edited": likeness(own, after), "near_next": likeness(own, theirs)}


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")
FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
          ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
          ("near_edited", pa.float64()), ("near_next", pa.float64())]
EDGE = [("edge", pa.string()), ("part", pa.int32()), ("text", pa.string())]


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered (doc_id, text) -> results, and both ends of the partition."""
    from pyspark import TaskContext
    part, schema = TaskContext.get().partitionId(), pa.schema(FIELDS + EDGE)
    last = None
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0), batch.column(1)):
            doc, text = doc.as_py(), text.as_py() or ""
            own = digest(text.encode())
            if last is None:
                rows.append({"edge": "first", "part": part, "doc_id": doc, "text": text,
                             "fingerprint": own})
            else:
                rows.append(compare(*last, text, own))
            last = doc, text, own
        yield pa.RecordBatch.from_pylist(rows, schema)
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"edge": "last", "part": part, "doc_id": last[0],
                                           "text": last[1], "fingerprint": last[2]}], schema)


def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pylist(
            [compare(r["doc_id"], r["text"], r["fingerprint"], r["next_text"], r["next_fingerprint"])
             for r in batch.to_pylist()], pa.schema(FIELDS))


def next_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, as in ``RESULT``."""
    keys = identity(id_col, text_col)
    ordered = (docs.select(*keys, F.col(id_col).cast("long").alias("doc_id"),
                           F.col(text_col).alias("text"))
               .repartitionByRange("d", "th").sortWithinPartitions("d", "th")
               .select("doc_id", "text"))
    streamed = written(ordered.mapInArrow(stream, RESULT + ", edge string, part int, text string"),
                       "fingerprints")
    inner = streamed.where(F.col("edge").isNull()).drop("edge", "part", "text")
    ends = streamed.where(F.col("edge").isNotNull())
    # the order of the partitions that have rows, the last followed by the first
    turn = W.orderBy("part")
    order = (ends.where(F.col("edge") == "last").select("part")
             .withColumn("following", F.lead("part").over(turn))
             .withColumn("lowest", F.min("part").over(turn))
             .select("part", F.coalesce("following", "lowest").alias("following")))
    first = ends.where(F.col("edge") == "first").select(
        F.col("part").alias("following"), F.col("text").alias("next_text"),
        F.col("fingerprint").alias("next_fingerprint"))
    last = ends.where(F.col("edge") == "last").select("part", "doc_id", "text", "fingerprint")
    joined = last.join(order, "part").join(first, "following").select(
        "doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    return inner.unionByName(joined.mapInArrow(join_edges, RESULT))
