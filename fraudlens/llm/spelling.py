"""Spelling variants by Bloom-guided edit neighbourhoods (operator 13).

The vocabulary (words of all texts and their counts) is a table. From it Spark
builds blocked Bloom filters, one per word length: each word sets ``PROBES``
bits of one 512-bit block, blocks are merged by ``bit_or``. Tasks then take the
vocabulary's words, hash every string one edit away by arithmetic on the word's
own hash (a replaced code point adds a multiple of a power, a deleted one joins
a prefix hash to a suffix hash) and look it up in the filter of that length.
Only strings that the filters know are built and shuffled to an exact join with
the vocabulary, which removes the false positives, so filters never change a
result. An insertion is the other word's deletion and a replacement is probed
by the word of the smaller code point, so each near pair is found once.

The filters' total size is at most ``FILTER_BYTES``, whatever the vocabulary;
beyond that the share of false positives rises. Tasks hold the filters of the
lengths they meet, and words come to them by length.

Defined results: null and empty texts have no words; a null id is hashed as an
empty string; repeated rows count again; words of any length are probed, a long
one in several steps; an empty table gives an empty result; other columns are
ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.common import lower_ascii, ship, written

ship(__name__)

LEAST_LENGTH, LEAST_COUNT, RATIO, DROP_EVERY = 6, 5, 5, 199
#: Filter size: bits a word, bits set by a word, and the bound of all filters.
BITS, PROBES, FILTER_BYTES = 16, 6, 64 << 20
#: Words from this length on share a filter, so there are few of them.
LONGEST_SHARD = 64
#: Probes hashed in one step, and code points of words dealt to one task.
STEP, TASK = 1 << 20, 50_000

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


# --------------------------------------------------------------- vocabulary
def misspelt(doc_id: Column, run: Column, every: int = DROP_EVERY) -> Column:
    """The lower-cased run, without one code point where ``every`` divides the
    hash of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at),
                                           F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = DROP_EVERY,
               least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all texts. A run shorter than a word can be cannot become
    one, so the pattern leaves it out."""
    runs = F.regexp_extract_all(F.col(text), F.lit("[A-Za-zÀ-ÿ]{%d,}" % least_length), F.lit(0))
    low = (docs.select(F.col(key).alias("k"), F.explode(runs).alias("run"))
           .select("k", lower_ascii(F.col("run")).alias("run")))
    return (low.select(misspelt(F.col("k"), F.col("run"), every).alias("word"))
            .where(F.length("word") >= least_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


# ------------------------------------------------------------------ hashing
def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row each; all are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def raw_hash(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def mixed(h: np.ndarray, length: int) -> np.ndarray:
    """The hash whose bits choose block and bits; the length takes part, as
    the longest lengths share a filter."""
    h = h + np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def shard_of(length: int) -> int:
    return min(length, LONGEST_SHARD)


def slots(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its places in the block's 512 bits."""
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    second = (h * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h >> np.uint64(29))
    bits = np.stack([(second >> np.uint64(9 * k)) & np.uint64(511) for k in range(PROBES)])
    return block.astype(np.int64), bits.astype(np.int64)


def known(filters: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter (blocks x 8 words of 64 bits) knows."""
    block, bits = slots(h, len(filters))
    out = np.ones(len(h), bool)
    left = np.arange(len(h))
    for row in bits:
        b = row[left]
        hit = (filters[block[left], b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1
        out[left[~hit]] = False
        left = left[hit]
    return out


# ------------------------------------------------------------------ filters
def build_filters(vocab: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Shard -> filter of that many blocks. What comes to the driver is the
    filters themselves, whose size ``filter_sizes`` bounds."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, words in by_length(batch.column(0).to_pylist()):
                shard = shard_of(length)
                block, bits = slots(mixed(raw_hash(matrix(words)), length), sizes[shard])
                places, at = np.unique(block, return_inverse=True)
                part = np.zeros((len(places), 8), np.uint64)
                for row in bits:
                    np.bitwise_or.at(part, (at, row >> 6), np.uint64(1) << (row & 63).astype(np.uint64))
                yield pa.record_batch([pa.array(np.full(len(places), shard, np.int32)), pa.array(places),
                                       *[pa.array(part[:, k].view(np.int64)) for k in range(8)]],
                                      ["shard", "block", *[f"w{k}" for k in range(8)]])
    cells = vocab.select("word").mapInArrow(
        fill, "shard int, block long, " + ", ".join(f"w{k} long" for k in range(8)))
    merged = cells.groupBy("shard", "block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8)])
    table = merged.toArrow()
    out = {s: np.zeros((n, 8), np.uint64) for s, n in sizes.items()}
    shard, block = table["shard"].to_numpy(), table["block"].to_numpy()
    for k in range(8):
        word = table[f"w{k}"].to_numpy().view(np.uint64)
        for s in out:
            out[s][block[shard == s], k] = word[shard == s]
    return out


def filter_sizes(counts: dict[int, int], bound: int = FILTER_BYTES) -> dict[int, int]:
    """Blocks of 64 bytes for each shard's words, at most ``bound`` bytes in
    all (and a block a shard)."""
    wanted = {s: n * BITS / 512 for s, n in counts.items()}
    share = min(1.0, bound / 64 / max(1.0, sum(wanted.values())))
    return {s: max(1, math.floor(w * share)) for s, w in wanted.items()}


def by_length(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    yield from groups.items()


# ------------------------------------------------------------------- probing
def probe(words: list[str], alphabet: np.ndarray, filters: dict) -> Iterator[tuple[int, str]]:
    """(row, neighbour) of words of one length for every neighbour the filters
    know: one code point deleted, or one replaced by a larger one."""
    codes = matrix(words)
    length = codes.shape[1]
    rows = max(1, STEP // (len(alphabet) * length))
    same, shorter = filters.get(shard_of(length)), filters.get(shard_of(length - 1))
    power = powers(length)
    for first in range(0, len(words), rows):
        part = codes[first:first + rows]
        terms = part.astype(np.uint64) * power
        h = terms.sum(axis=1, dtype=np.uint64)
        before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
        # a long word's positions are taken in steps too
        width = max(1, STEP // (len(alphabet) * len(part)))
        for lo in range(0, length, width):
            span = slice(lo, min(lo + width, length))
            if shorter is not None:
                gone = before[:, span] + (h[:, None] - before[:, span] - terms[:, span]) * INVERSE
                fresh = np.ones(gone.shape, bool)       # in a run of equal code points, the first only
                skip = int(lo == 0)
                fresh[:, skip:] = part[:, lo + skip:span.stop] != part[:, lo + skip - 1:span.stop - 1]
                r, p = np.nonzero(fresh)
                hit = known(shorter, mixed(gone[r, p], length - 1))
                for i, k in zip(r[hit].tolist(), (p[hit] + lo).tolist()):
                    w = words[first + i]
                    yield first + i, w[:k] + w[k + 1:]
            larger = alphabet[None, None, :] > part[:, span, None]
            r, p, a = np.nonzero(larger)
            change = (alphabet[a].astype(np.uint64) - part[r, p + lo].astype(np.uint64)) * power[p + lo]
            hit = known(same, mixed(h[r] + change, length))
            for i, k, c in zip(r[hit].tolist(), (p[hit] + lo).tolist(), alphabet[a[hit]].tolist()):
                w = words[first + i]
                yield first + i, w[:k] + chr(c) + w[k + 1:]


OUT = 4096


def candidates(vocab: DataFrame, alphabet: np.ndarray, filters: dict) -> DataFrame:
    """(word, n, other) for the neighbours that the filters know."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.record_batch([pa.array([r[0] for r in rows], pa.string()),
                                    pa.array([r[1] for r in rows], pa.int64()),
                                    pa.array([r[2] for r in rows], pa.string())], ["word", "n", "other"])
        for batch in batches:
            n_of = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for length, words in by_length(list(n_of)):
                held = {s: filters[s].value for s in {shard_of(length), shard_of(length - 1)} if s in filters}
                rows = []
                for i, other in probe(words, alphabet, held):
                    rows.append((words[i], n_of[words[i]], other))
                    if len(rows) == OUT:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)
    return vocab.select("word", "n").mapInArrow(run, "word string, n long, other string")


def near_pairs(vocab: DataFrame, bound: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, other_n), both ways, for all words one edit apart."""
    spark = vocab.sparkSession
    shard = F.least(F.length("word"), F.lit(LONGEST_SHARD)).alias("shard")
    sizes = vocab.groupBy(shard).agg(F.count(F.lit(1)).alias("n"),
                                     F.sum(F.length("word")).alias("points")).collect()
    counts = {r.shard: r.n for r in sizes}
    # numbered, as the rows are few bytes but much work
    tasks = max(1, -(-sum(r.points for r in sizes) // TASK))
    # at most 256 code points, all below 256
    seen = vocab.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()
    alphabet = np.array(sorted(ord(r.c) for r in seen if r.c), np.uint8)
    filters = {s: spark.sparkContext.broadcast(f)
               for s, f in build_filters(vocab, filter_sizes(counts, bound)).items()}
    known_words = vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    one_way = written(candidates(vocab.repartitionByRange(tasks, F.length("word"), "word"), alphabet, filters)
                      .join(known_words, "other").select("word", "n", "other", "other_n"), "near")
    return one_way.union(one_way.select("other", "other_n", "word", "n"))


# ----------------------------------------------------------------- grouping
def follow(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) from (word, form): chains of at most ``steps`` forms,
    their reach doubled each round."""
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        far = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        roots = written(roots.join(far, "root", "left")
                        .select("word", F.coalesce("far", "root").alias("root")), "roots")
    return roots


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = DROP_EVERY,
             least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             ratio: int = RATIO) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root. The ratio is at
    least 2, so counts grow along a chain of forms and it ends."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    vocab = written(vocabulary(docs, key, text, every, least_length, least_count), "vocabulary")
    top = vocab.agg(F.max("n")).first()[0] or 0
    near = (near_pairs(vocab).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"),
                 F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best")))
    found = F.col("best.m") * -1 >= F.col("n") * ratio
    words = written(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(found, F.col("best.w")).alias("form"),
        F.when(found, -F.col("best.m")).alias("form_n")), "words")
    # counts grow by the ratio at each step, which bounds a chain
    steps = math.ceil(math.log(max(1, top / least_count), ratio))
    roots = follow(words.where("form is not null").select("word", "form"), steps)
    return (words.join(roots, "word", "left")
            .withColumn("root", F.coalesce("root", "word"))
            .select("word", "n", "n_near", "form", "form_n", "root"))
