"""Byte-level BPE encoding and decoding with a rank file (operator 6).

Words (matches of the split pattern) are encoded once per distinct word: the
ranked merges are folded over the word's bytes, the pair of the least rank
first, and a text's ids are those of its words in order. Decoding
concatenates the binary pieces of the ids.

The fold exists twice. ``encode_words`` is Spark's: higher-order functions
fold over an array of the word's bytes with the rank map as a literal (an
array of small maps addressed by a checksum, as Spark's map lookup is a
linear search). It suits tables of distinct words. Whole corpora need it for
each task's distinct words, which took about 180 microseconds a word against
some 6 in ``merged`` (README), so ``encoded_documents`` folds in Arrow tasks
with a bounded table of known words. Both give the same ids.

Documents are encoded where they lie: one narrow stage, no shuffle. Words of
more than ``FOLD_BYTES`` bytes (runs of blanks, encoded data), on which a
fold takes quadratic time, are merged with a heap, to the same ids.

Defined results: null and empty texts have no ids; text that looks like a
special token is plain text; repeated rows are encoded alike; extra columns
are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.common import let, ship

ship(__name__)

FOLD_BYTES = 48
#: Distinct words that a task remembers before it starts anew.
KNOWN_WORDS = 400_000
SLOTS = 1 << 16
NO_RANK = 2 ** 31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class RankMap:
    """The rank file as a literal column that finds keys without a search."""

    def __init__(self, ranks: dict[bytes, int]):
        slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
        for piece, rank in ranks.items():
            key = piece.hex().upper()
            slots[zlib.crc32(key.encode()) % SLOTS][key] = rank
        self.table = F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))),
                                 "array<map<string,int>>")

    def rank(self, key: Column) -> Column:
        slot = (F.crc32(key.cast("binary")) % SLOTS).cast("int")
        return F.coalesce(F.try_element_at(F.get(self.table, slot), key), F.lit(NO_RANK))


def folded(word: Column, ranks: RankMap) -> Column:
    """Ids of a word given as upper-case hexadecimal bytes."""
    def merge(parts, marks):
        def at(i):
            joined = F.concat(F.get(parts, i), F.get(parts, i + 1))
            return F.concat(F.slice(parts, F.lit(1), i), F.array(joined),
                            F.slice(parts, i + 3, F.size(parts)))
        least = F.array_min(marks)
        done = F.struct(parts.alias("parts"), F.lit(True).alias("done"))
        more = F.struct(let((F.array_position(marks, least) - 1).cast("int"), at).alias("parts"),
                        F.lit(False).alias("done"))
        return F.when(least == NO_RANK, done).otherwise(more)

    def step(acc, _):
        parts = acc["parts"]
        pairs = F.transform(F.sequence(F.lit(0), F.size(parts) - 2),
                            lambda i: ranks.rank(F.concat(F.get(parts, i), F.get(parts, i + 1))))
        return F.when(acc["done"] | (F.size(parts) < 2), acc).otherwise(
            let(pairs, lambda marks: merge(parts, marks)))

    n = (F.length(word) / 2).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(word, 2 * i + 1, F.lit(2)))
    start = F.struct(parts.alias("parts"), F.lit(False).alias("done"))
    by_merges = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step,
                            lambda acc: F.transform(acc["parts"], lambda p: ranks.rank(p)))
    return let(ranks.rank(word), lambda whole: F.when(whole != NO_RANK, F.array(whole))
               .otherwise(by_merges))


def encode_words(table: DataFrame, path: str, word_col: str = "word") -> DataFrame:
    """The rows of a table of distinct words with ``ids``, folded by Spark."""
    ranks = RankMap(read_ranks(path))
    word = F.hex(F.col(word_col).cast("binary"))
    ids = F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(folded(word, ranks))
    return table.select("*", ids.alias("ids"))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the least ranked pair merges until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > FOLD_BYTES:
        return heap_merged(word, ranks)
    rank = ranks.get
    parts = [word[i:i + 1] for i in range(len(word))]
    pairs = [rank(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while pairs:
        least = min(pairs)
        if least == NO_RANK:
            break
        i = pairs.index(least)
        del pairs[i]
        parts[i] += parts.pop(i + 1)
        if i < len(pairs):
            pairs[i] = rank(parts[i] + parts[i + 1], NO_RANK)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + parts[i], NO_RANK)
    return [ranks[p] for p in parts]


def heap_merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of adjacent pairs."""
    parts: list[bytes | None] = [word[i:i + 1] for i in range(len(word))]
    after, before = [*range(1, len(word)), -1], [-1, *range(len(word) - 1)]
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0:
            pair = parts[i] + parts[after[i]]
            if pair in ranks:
                heapq.heappush(heap, (ranks[pair], i, pair))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else -1
        if j < 0 or parts[i] + parts[j] != pair:
            continue                                   # an earlier merge took a side
        parts[i], parts[j], after[i] = pair, None, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in parts if p is not None]


def encoded_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                      text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if wanted), ids_sha256, decoded_sha256 per row."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ranks = regex.compile(pattern).findall, read_ranks(path)
        pieces = {rank: piece for piece, rank in ranks.items()}
        known: dict[str, tuple] = {}           # word: ids, in decimals, decoded

        def learn(word: str) -> tuple:
            ids = merged(word.encode(), ranks)
            entry = known[word] = ids, " ".join(map(str, ids)), decoded(ids, pieces)
            return entry

        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                parts = [known.get(w) or learn(w) for w in find(text.as_py() or "")]
                out.append((doc.as_py(), sum([len(p[0]) for p in parts]),
                            [i for p in parts for i in p[0]] if with_ids else None,
                            hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest(),
                            hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest()))
                if len(known) > KNOWN_WORDS:
                    known.clear()
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>, "
                                   "ids_sha256 string, decoded_sha256 string")


def decoded(ids: list[int], pieces: dict[int, bytes]) -> bytes:
    return b"".join(pieces[i] for i in ids)
