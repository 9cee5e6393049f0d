"""Best-fit packing of tokenized documents by a length histogram (operator 5).

Tasks tokenize whole texts and cut only documents longer than a sequence.
The plan is made over counts: the histogram of piece lengths (at most
``capacity`` rows) comes to the driver, and best-fit decreasing places whole
runs of equal lengths: of the open sequences the run goes to those with the
least room that is enough. Runs of sequences that were filled alike are one
entry, so the plan's size depends on the capacity and not on the corpus. Each
piece then takes the planned slot of its rank within its length; ranks come
from range partitions, never from a window over a whole length.

Tokenizing is the library's with the vocabulary file given: the file's merges
run through tiktoken when its ids are in merge order (then both give the same
ids, some four times faster) and through tokenizers otherwise.

Defined results: null and empty texts are the end token alone; repeated rows
are packed separately; an empty table gives an empty result; extra columns
are ignored.
"""
from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.common import gapless_rank, ship, written

ship(__name__)

CAPACITY = 1024
END = 2


def byte_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str, pattern: str) -> Callable[[str], list[int]]:
    """text -> ids by a byte-level BPE file; special tokens are plain text."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, alphabet = model["vocab"], byte_alphabet()
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [vocab[x] for x in merged]
    if all(a < b for a, b in zip(ids, ids[1:])):
        import tiktoken
        ranks = {bytes(alphabet[c] for c in x): vocab[x] for x in [*alphabet, *merged]}
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks,
                                 special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return lambda text: whole.encode(text, add_special_tokens=False).ids


def tokenized(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str,
              capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or encoder(path, pattern)
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    own = ids[a:b]
                    rows.append((doc.as_py(), piece, a, b - a, zlib.crc32(own.tobytes()),
                                 own.tolist() if with_ids else None))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                               "ids array<long>")
    return out if with_ids else out.drop("ids")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, count, first
    sequence, offset) of every run of slots."""
    slots, free, made = [], defaultdict(list), 0      # free: room -> [(first sequence, count)]
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = next((r for r in range(length, capacity) if free[r]), None)
            fresh = room is None                      # nothing has room: new sequences
            first, n = (made, left) if fresh else free[room].pop()
            room = capacity if fresh else room
            deep = room // length                     # a sequence is filled before the next is begun
            full = min(n, left // deep)
            used = 0
            for count, depth in ((full, deep), (1, left - full * deep if full < n else 0)):
                if count and 0 < depth <= deep:
                    for k in range(depth):
                        slots.append((length, rank, count, first + used, capacity - room + k * length))
                        rank += count
                    free[room - depth * length].append((first + used, count))
                    used += count
                    left -= count * depth
            if fresh:
                made += used
            elif used < n:
                free[room].append((first + used, n - used))
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, start, length, ...) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in
                 pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(histogram, capacity),
        "length long, first_rank long, n long, first_sequence long, offset long")
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "start", "ids_crc32"], "__rank")
    inside = ((F.col("__rank") >= F.col("first_rank"))
              & (F.col("__rank") < F.col("first_rank") + F.col("n")))
    slots = slots.withColumnRenamed("length", "slot_length")
    return (ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & inside)
            .withColumn("sequence_id", F.col("first_sequence") + F.col("__rank") - F.col("first_rank"))
            .drop("__rank", "slot_length", "first_rank", "n", "first_sequence"))


def pack_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                   text_col: str = "text", capacity: int = CAPACITY, end: int = END,
                   with_ids: bool = False) -> DataFrame:
    pieces = tokenized(docs, path, pattern, id_col, text_col, capacity, end, with_ids)
    return pack(written(pieces, "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with their ids."""
    return (packed.groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")))
