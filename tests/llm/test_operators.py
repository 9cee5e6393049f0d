"""Each operator against a brute-force version, and on hard inputs: nulls,
empty and very long texts, repeated rows, empty tables, clashing columns."""
import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from fraudlens.llm import (bpe, fingerprint, line_dedup, near_dedup, packing, pii, quality,
                           sharding, url_lists, warc)
from fraudlens.llm import registered as R
from fraudlens.llm.common import gapless_rank

P = pytest.importorskip("public_tokenizers")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = str.maketrans(UPPER, UPPER.lower())
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ["row", "d", "th", "w", "t", "p", "key", "keep", "node", "nid", "base", "spans", "score",
           "bucket", "h1", "kept", "quality", "line", "at", "length", "shard", "group"]

_rnd = random.Random(5)
VOCAB = ["".join(_rnd.choice("abcdefgh") for _ in range(_rnd.randrange(2, 7))) for _ in range(400)]
PROSE = " ".join(_rnd.choice(VOCAB) for _ in range(120))
LONG = "\n".join(" ".join(_rnd.choice(VOCAB) for _ in range(20)) for _ in range(1500)) + " " + "x" * 100_000
HARD = [(1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, LONG), (6, PROSE), (6, PROSE),
        (None, PROSE), (None, None), (7, PROSE.upper() + " tail"), (8, PROSE.replace(" ", "\n", 60)),
        (9, "mail a.b@c.de or +1 (234) 567-8901, 10.0.0.256 10.0.0.25 4111 1111 1111 1111"),
        (10, "éè \U0001f600 café   naïve"), (11, "a\r\nb\x0bc\x0cd\n\n")]


def hard(spark, rows=HARD):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("*", *[F.lit(f"{c}!").alias(c) for c in CLASHES])


def small(spark):
    return R.load(spark, SF_SMALL, "documents").select("doc_id", "text")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- 1 near-dedup
def shingle_sets(rows, width):
    out = []
    for doc, text in rows:
        w = WORD.findall((text or "").translate(ASCII_LOWER))
        n = max(1, len(w) - width + 1)
        out.append((doc, frozenset(tuple(w[k:k + width]) for k in range(n)) if w else frozenset()))
    return out


def linked_components(rows, num, den, width):
    sets = shingle_sets(rows, width)
    part = list(range(len(sets)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            both = len(a & b)
            if both and den * both >= num * (len(a) + len(b) - both):
                part[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(s), least.get(find(i)) if s else doc) for i, (doc, s) in enumerate(sets))


@pytest.mark.parametrize("num,den,width", [(85, 100, 3), (4, 5, 5)])
def test_near_dedup_equals_brute_force(spark, num, den, width):
    rows = texts(small(spark))
    out = near_dedup.near_duplicates(small(spark), num, den, width).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == \
        linked_components(rows, num, den, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_dedup_hard_inputs(spark):
    out = near_dedup.near_duplicates(hard(spark), 85, 100, 3).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == \
        linked_components(HARD, 85, 100, 3)
    one = near_dedup.keep_one(hard(spark), 85, 100, 3)
    assert one.columns == hard(spark).columns
    ids = [r.doc_id for r in one.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 9, 10, 11]
    assert near_dedup.keep_one(hard(spark, [])).count() == 0


def test_near_dedup_group_larger_than_a_block(spark, monkeypatch):
    """Near copies whose group is dealt over many cells: a chain of edits, so
    components need links that cross blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    rnd, rows = random.Random(1), []
    words = [rnd.choice(VOCAB) for _ in range(150)]
    for i in range(60):
        words = list(words)
        words[rnd.randrange(150)] = f"edit{i}"
        rows.append((i, " ".join(words)))
    out = near_dedup.near_duplicates(hard(spark, rows), 85, 100, 3).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == \
        linked_components(rows, 85, 100, 3)


def edited_copies(n, edits, seed=3):
    """One text of 200 words and copies of it with words replaced."""
    rnd = random.Random(seed)
    base = [f"word{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        words = list(base)
        for k in rnd.sample(range(200), edits):
            words[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("edits", [1, 4])
def test_near_dedup_set_rows_grow_with_the_members(spark, monkeypatch, edits):
    """A hot group of 4 and of 16 blocks: sets dealt to cells grow as the
    members do. With 4 edits two copies are mostly linked by the original alone."""
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    monkeypatch.setattr(near_dedup, "PIVOTS", 4)
    compared, dealt = near_dedup.compared, {}
    for n in (128, 512):
        seen = []

        def counted(cells, *rest):
            seen.append(cells.count())
            return compared(cells, *rest)
        monkeypatch.setattr(near_dedup, "compared", counted)
        rows = edited_copies(n, edits)
        out = near_dedup.near_duplicates(hard(spark, rows), 85, 100, 3).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == \
            linked_components(rows, 85, 100, 3)
        dealt[n] = sum(seen)
    assert dealt[512] < 7 * dealt[128], dealt


def test_near_dedup_families_that_collide(spark, monkeypatch):
    """Several originals that share most of their words: members of one group
    that stay apart are compared in full."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    rnd, rows = random.Random(5), []
    for family in range(6):
        for _ in range(12):
            words = [f"word{k}" for k in range(160)] + [f"family{family}word{k}" for k in range(25)]
            words[rnd.randrange(160)] = f"edit{len(rows)}"
            rows.append((len(rows), " ".join(words)))
    for num in (85, 70):
        out = near_dedup.near_duplicates(hard(spark, rows), num, 100, 3).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == \
            linked_components(rows, num, 100, 3)


def test_least_matches_bounds_the_miss():
    for s in (0.8, 0.85, 0.95):
        t = near_dedup.least_matches(s)
        from math import comb
        below = sum(comb(64, k) * s ** k * (1 - s) ** (64 - k) for k in range(t))
        assert below <= near_dedup.MISS


# ---------------------------------------------------------------- 2 line dedup
def kept_lines(rows, min_chars=20, min_docs=3):
    trim = lambda x: x.strip(" \t\n\x0b\f\r").translate(ASCII_LOWER)
    order = lambda doc: -(2 ** 63) if doc is None else doc
    holders = defaultdict(set)
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if len(trim(x)) >= min_chars:
                holders[trim(x)].add(order(doc))
    out = Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(holders.get(trim(x), ())) < min_docs
                or max(holders[trim(x)]) == order(doc)]
        out[doc, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    return out


@pytest.mark.parametrize("hot_floor", [1, 1024])
def test_line_dedup_equals_brute_force(spark, hot_floor):
    shared = ["This line is in many documents. ", "\tTHIS LINE IS IN MANY DOCUMENTS.", "short", ""]
    rnd = random.Random(3)
    rows = HARD + [(100 + i, "\n".join(rnd.choice(shared + [f"only document {i} has this line"])
                                       for _ in range(130))) for i in range(12)]
    out = line_dedup.dedup_lines(hard(spark, rows), hot_floor=hot_floor)
    assert out.columns == [*hard(spark).columns, "line_report"]
    got = Counter((r.doc_id, r.line_report.n_lines, r.line_report.n_dropped, r.line_report.text)
                  for r in out.collect())
    assert got == kept_lines(rows)


def test_line_dedup_empty_table(spark):
    assert line_dedup.dedup_lines(hard(spark, [])).count() == 0


# ------------------------------------------------------------------ 3 sharding
def test_sharding_law_and_slots(spark):
    rows = [(100 + i, "x" * (i % 7)) for i in range(3000)] + HARD
    out = sharding.shard_documents(hard(spark, rows)).collect()
    assert len(out) == len(rows)
    by_shard = defaultdict(list)
    for r in out:
        by_shard[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert max(map(len, by_shard.values())) < 2 * min(map(len, by_shard.values()))
    text = {i: t or "" for i, t in rows if i is not None}
    for r in out:
        if r.doc_id is not None:
            data = text[r.doc_id].encode()
            assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))


def placed(spark, **trees):
    ids = spark.range(6000).select(F.col("id").alias("doc_id"))
    return sharding.place(ids, F.col("doc_id"), trees).collect()


def test_new_shard_takes_rows_only_into_itself(spark):
    for n in (1, 5, 9, 24):
        out = placed(spark, a=sharding.layout(n), b=sharding.grown(sharding.layout(n)))
        assert all(r.b in (r.a, n) for r in out)
        assert abs(sum(r.b == n for r in out) / len(out) - 1 / (n + 1)) < 0.02


def test_sharding_moves_only_into_changed_subtrees(spark):
    plain = sharding.layout(24)
    heavy = [sharding.Shard(s.region, s.rack, s.shard, 5.0 if s.shard == 9 else 1.0) for s in plain]
    region, rack = ({s.shard: getattr(s, level) for s in plain} for level in ("region", "rack"))
    out = placed(spark, a=plain, b=heavy)
    moved = [r for r in out if r.a != r.b]
    # shard 9 is in rack 2 of region 1: all moves end in that region, those inside it in that rack,
    # those inside the rack in that shard
    assert moved and all(region[r.b] == 1 for r in moved)
    assert all(rack[r.b] == 2 for r in moved if region[r.a] == 1)
    assert all(r.b == 9 for r in moved if rack[r.a] == 2)
    assert abs(sum(r.b == 9 for r in out) / len(out) - 5 / 28) < 0.03


def test_descent_is_not_a_flat_draw(spark):
    tree = sharding.layout(24)
    flat = [sharding.Shard(0, 0, s.shard) for s in tree]
    out = placed(spark, a=tree, b=flat)
    assert sum(r.a == r.b for r in out) < 0.5 * len(out)


def test_sharding_of_an_empty_table(spark):
    assert sharding.shard_documents(hard(spark).limit(0)).count() == 0


def test_gapless_rank_with_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 > 0, F.lit("hot")).alias("g"),
                                  F.col("id").alias("o"), F.lit(1).alias("extra"))
    ranks = defaultdict(list)
    for r in gapless_rank(df, ["g"], ["o"], "rank").collect():
        ranks[r.g].append((r.rank, r.o))
    for own in ranks.values():
        own.sort()
        assert [x for x, _ in own] == list(range(len(own)))
        assert [o for _, o in own] == sorted(o for _, o in own)


# ------------------------------------------------------------------- 4 quality
def base_counts(text):
    text = text or ""
    words, starts, covered = WORD.findall(text), defaultdict(list), set()
    for k in range(len(words) - 7):
        starts[tuple(words[k:k + 8])].append(k)
    for own in starts.values():
        if len(own) > 1:
            for k in own:
                covered.update(range(k, k + 8))
    full = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(full) - len(set(full)), len(covered), failed)


def test_quality_counts_and_verdict(spark):
    repeats = PROSE + " " + " ".join(PROSE.split()[3:40]) + " | # " + PROSE[:80] + "\nl x\nl x\n\n"
    rows = HARD + [(20, repeats), (21, "a " * 200), (22, "%% && || " * 30)]
    good = [(1000 + i, " ".join(_rnd.choice(VOCAB) for _ in range(150))) for i in range(60)]
    junk = [(2000 + i, " ".join(_rnd.choice(VOCAB) + "%%%" for _ in range(150))) for i in range(20)]
    docs = hard(spark, rows + good + junk)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(None, 1), (2000, 0), (2000, 0)],
                                   "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.judge(docs, model).collect()
    assert len(out) == docs.count()
    want = Counter((i, *base_counts(t)) for i, t in rows + good + junk)
    q = [(r.doc_id, r.quality) for r in out]
    assert Counter((i, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words,
                    x.base_failed) for i, x in q) == want
    assert all(x.kept for i, x in q if i is not None and 1000 <= i < 2000)
    assert not any(x.kept for i, x in q if i is not None and i >= 2000)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(x.kept for _, x in q)


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.judge(hard(spark), quality.fit(hard(spark), none)).collect()
    assert all(r.quality.kept == (not r.quality.base_failed) for r in out)
    empty = hard(spark, [])
    assert quality.judge(empty, quality.fit(empty, none)).count() == 0


# ------------------------------------------------------------------- 5 packing
def test_plan_places_every_count_without_overlap():
    rnd = random.Random(2)
    for _ in range(20):
        counts = {n: rnd.randrange(1, 40) for n in rnd.sample(range(1, 65), 20)}
        filled, ranks = defaultdict(list), defaultdict(list)
        for length, rank, n, first, offset in packing.plan(counts, 64):
            for k in range(n):
                filled[first + k].append((offset, length))
                ranks[length].append(rank + k)
        assert all(sorted(ranks[n]) == list(range(c)) for n, c in counts.items())
        for own in filled.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 64
        rooms = []                                     # best-fit decreasing, piece by piece
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fits = [r for r in rooms if r >= n]
                room = min(fits) if fits else 64
                if fits:
                    rooms.remove(room)
                rooms.append(room - n)
        assert len(filled) == len(rooms)


def test_packing_hard_inputs(spark):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    rows = HARD + [(30, "<|endoftext|> is plain text here"), (31, PROSE * 20)]
    out = packing.pack_documents(hard(spark, rows), P.path("byte_bpe_50k.json"), P.PATTERN,
                                 with_ids=True).cache()
    got, want = Counter(), Counter()
    for r in out.collect():
        assert r.length <= 1024
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    for doc, text in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))
            want[doc, k, a, b - a, crc] += 1
    assert got == want
    for s in packing.sequences(out).collect():
        parts = out.where(F.col("sequence_id") == s.sequence_id).orderBy("offset").collect()
        assert s.ids == [i for r in parts for i in r.ids] and len(s.ids) <= 1024
        break
    ends = defaultdict(int)
    for r in sorted(out.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert packing.pack_documents(hard(spark, []), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


# ----------------------------------------------------------------------- 6 BPE
def test_bpe_equals_the_library_and_round_trips(spark):
    import tiktoken
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(9)
    odd = ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x3000),
                                   rnd.randrange(0x1F000, 0x1FAFF)])) for _ in range(60)) for _ in range(50)]
    rows = HARD + [(100 + i, t) for i, t in enumerate(odd)] + [(90, "<|endoftext|>"), (91, " " * 5000)]
    out = bpe.encoded_documents(hard(spark, rows), path, P.PATTERN).collect()
    pieces = {rank: piece for piece, rank in ranks.items()}
    want = Counter()
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        assert bpe.decoded(ids, pieces) == (text or "").encode()
        want[doc, len(ids), tuple(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded_sha256)
                   for r in out) == want
    assert bpe.encoded_documents(hard(spark, []), path, P.PATTERN).count() == 0


def test_spark_fold_equals_task_fold(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    rnd = random.Random(4)
    words = {"".join(rnd.choice("etaoins abé") for _ in range(rnd.randrange(1, 20))) for _ in range(300)}
    table = spark.createDataFrame([(w,) for w in [*sorted(words), ""]], "word string")
    for r in bpe.encode_words(table, path).collect():
        assert r.ids == (bpe.merged(r.word.encode(), ranks) if r.word else [])


def test_heap_merge_equals_fold():
    ranks = {base64.b64decode(a): int(b) for a, b in
             map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    rnd = random.Random(8)
    for _ in range(300):
        word = bytes(rnd.choice(b"etaoin \xc3\xa9") for _ in range(rnd.randrange(2, bpe.FOLD_BYTES)))
        if word not in ranks:
            assert bpe.heap_merged(word, ranks) == bpe.merged(word, ranks)


# -------------------------------------------------------------- 7 fingerprints
def test_fingerprints_follow_the_order_of_ids(spark):
    rows = [(i, t) for i, t in HARD if i is not None and i != 6] + [(40 + i, PROSE[i * 9:]) for i in range(9)]
    out = {r.doc_id: r for r in fingerprint.next_likeness(hard(spark, rows)).collect()}
    rows.sort()
    for k, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = (text[:len(text) - half] + following[:half]).encode()
        r = out[doc]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed).hexdigest()
        assert r.fingerprint == fingerprint.digest(text.encode())
        assert r.edited_fingerprint == fingerprint.digest(changed)
        assert r.near_next == fingerprint.likeness(r.fingerprint, fingerprint.digest(following.encode()))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_fingerprint_properties(spark):
    a, b = fingerprint.digest(LONG.encode()), fingerprint.digest((LONG[:-200] + "y" * 200).encode())
    c = fingerprint.digest(" ".join(reversed(["zzz qq", "0123"] * 400)).encode())
    assert fingerprint.likeness(a, a) == 1 and fingerprint.likeness(a, b) > 0.9
    assert fingerprint.likeness(a, c) < fingerprint.likeness(a, b)
    assert fingerprint.next_likeness(hard(spark, [(1, "solo text")])).first().near_next == 1
    assert fingerprint.next_likeness(hard(spark, [])).count() == 0
    assert fingerprint.next_likeness(hard(spark)).count() == len(HARD)


# ------------------------------------------------------------------------ 8 PII
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(digits):
        total = 0
        for k, c in enumerate(reversed(digits)):
            v = int(c) * (1 + k % 2)
            total += v - 9 * (v > 9)
        return total % 10 == 0

    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15}[kind]
    spans = [(m.start(), i, m.end()) for i, kind in enumerate(pii.KINDS)
             for m in re.finditer(PLAIN[kind], text or "") if ok(kind, m.group())]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_pii_base_spans_equal_plain_patterns(spark):
    tricky = ["a@b.c_x@d.e", "x.y@@z.w a@b a@b.c.d-e.f. +++1 23456789 +1(2)3-4.5 67890",
              "1.2.3.4.5.6.7.8 001.2.3.4 999999999999.1.1.1 256.1.1.1", "4111-1111 1111-1111 1",
              "0" * 30, "4111111111111111" * 3, "café@x.yz \U0001f600 éa@b.cd", "+1" * 50,
              "a." * 3000 + "@x.y", "1 " * 3000, "b" * 50_000 + "@c.d.e", "12-34-56-78-90-12-34 +49 30 1234567"]
    rows = HARD + [(50 + i, t) for i, t in enumerate(tricky)]
    out = pii.find(hard(spark, rows)).select("doc_id", pii.listed(F.col("base")).alias("s")).collect()
    assert Counter((r.doc_id, r.s) for r in out) == Counter((i, plain_spans(t)) for i, t in rows)
    assert pii.find(hard(spark, [])).count() == 0


def luhn_card(rnd):
    body = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
    return next(body + c for c in "0123456789"
                if plain_spans(body + c).startswith("card"))


def test_pii_context_finds_unseen_identifiers(spark):
    """Numbers in the place of cards that fail the checksum are found by their
    context; the same numbers elsewhere are left alone."""
    rnd, rows = random.Random(6), []
    for i in range(40):
        card = luhn_card(rnd)
        if i >= 36:                                  # a digit off
            card = card[:-1] + str((int(card[-1]) + 1) % 10)
        words = [rnd.choice(VOCAB) for _ in range(20)]
        rows.append((i, " ".join(words[:9] + ["cardnumber:", card, "expires"] + words[9:])))
    numbers = [n for n in (f"4987{i:05}1234567" for i in range(9)) if not plain_spans(n)][:4]
    rows += [(100 + i, f"{rnd.choice(VOCAB)} {rnd.choice(VOCAB)} {n} {rnd.choice(VOCAB)}")
             for i, n in enumerate(numbers)]
    docs = hard(spark, rows)
    out = {r.doc_id: r for r in pii.find(docs).select(
        "doc_id", F.size("base").alias("base"), "spans").collect()}
    assert all(out[i].base == 1 and len(out[i].spans) == 1 for i in range(36))
    for i in range(36, 40):
        text = dict(rows)[i]
        (span,) = out[i].spans
        assert out[i].base == 0 and pii.KINDS[span.kind] == "card"
        assert text[span.start:span.end] == text.split()[10]
    assert all(not out[i].spans for i in range(100, 104))
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert all("cardnumber: <card> expires" in masked[i] for i in range(40))
    assert pii.mask(docs).columns == docs.columns


def wrong_cards(n):
    """Card-like numbers that fail the checksum."""
    return [c for c in (f"4{i:03}987612345670" for i in range(900)) if not plain_spans(c)][:n]


def test_pii_known_instances_support_further_patterns(spark):
    """An unseen number is found after 'card' although it occurs elsewhere too;
    numbers found there make 'acct' a pattern, which finds another one."""
    rnd = random.Random(11)
    a_word = lambda: rnd.choice(VOCAB)
    rows = [(i, f"{a_word()} card {luhn_card(rnd)} {a_word()}") for i in range(300)]
    *unseen, last, alone = wrong_cards(10)
    for i, number in enumerate(unseen):
        rows.append((1000 + i, f"{a_word()} card {number} {a_word()}"))
        rows += [(2000 + 10 * i + k, f"{a_word()} acct {number} closed") for k in range(4)]
    rows += [(3000, f"{a_word()} acct {last} {a_word()}"), (3001, f"{a_word()} {alone} {a_word()}")]
    rows += [(3010 + k, f"{a_word()} {unseen[0]} {a_word()}") for k in range(3)]
    got = {r.doc_id: r.s for r in pii.find(hard(spark, rows)).select(
        "doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    for doc, text in rows:
        at = re.search("[0-9]+", text)
        want = "" if 3000 < doc else f"card:{at.start()}:{at.end()}"
        assert got[doc] == want, text


def test_pii_context_finds_other_shapes(spark):
    """Identifiers of shapes that no seed has, and spaced ones as a whole."""
    rnd = random.Random(12)
    a_word = lambda: rnd.choice(VOCAB)
    seeds = {"phone": lambda: f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}",
             "card": lambda: luhn_card(rnd), "email": lambda: f"{a_word()}@{a_word()}.org"}
    rows = [(i, f"{a_word()} my{kind} {make()} {a_word()}")
            for i, (kind, make) in enumerate(x for x in seeds.items() for _ in range(80))]
    unseen = [("phone", "555-123-4567"), ("phone", "(974) 555-3436"), ("phone", "974 555 3436"),
              ("phone", "55512"), ("card", "4111 1111 1111 1112"), ("email", "name@host")]
    rows += [(1000 + i, f"{a_word()} my{kind} {what}, {a_word()}") for i, (kind, what) in enumerate(unseen)]
    rows += [(2000 + i, f"{a_word()} {a_word()} {what}, {a_word()}") for i, (_, what) in enumerate(unseen)]
    docs = hard(spark, rows)
    got = {r.doc_id: r.s for r in pii.find(docs).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    for i, (kind, what) in enumerate(unseen):
        at = rows[len(rows) - 2 * len(unseen) + i][1].index(what)
        assert got[1000 + i] == f"{kind}:{at}:{at + len(what)}", what
        assert got[2000 + i] == "", what


def test_pii_shapes_tell_numbers_after_a_shared_word(spark):
    """A word before cards and years alike is a pattern for card shapes only."""
    rnd = random.Random(14)
    a_word = lambda: rnd.choice(VOCAB)
    rows = [(i, f"{a_word()} number {luhn_card(rnd) if i % 2 else 1900 + i} {a_word()}") for i in range(120)]
    rows.append((1000, f"x number {wrong_cards(1)[0]} y"))
    got = {r.doc_id: r.s for r in pii.find(hard(spark, rows)).select(
        "doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert got[1000] == "card:9:25" and not any(got[i] for i in range(0, 120, 2))


def test_pii_contexts_are_whole_words(spark):
    """A word is a number's neighbour over any number of blanks, and long words
    that differ late are different."""
    rnd, stem, gap = random.Random(13), "w" * 45, " " * 100
    rows = [(i, f"77-x {rnd.choice(VOCAB)} {word} {luhn_card(rnd)} {rnd.choice(VOCAB)}")
            for i, word in enumerate(["card", stem + "one"] * 60)]
    unseen = wrong_cards(3)
    rows += [(1000 + i, f"{rnd.choice(VOCAB)} {lead}{number} {rnd.choice(VOCAB)}")
             for i, (lead, number) in enumerate(zip([f"card{gap}", f"{stem}one\n", f"{stem}two "], unseen))]
    got = {r.doc_id: r.s for r in pii.find(hard(spark, rows)).select(
        "doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    for i, number in enumerate(unseen):
        at = dict(rows)[1000 + i].index(number)
        assert got[1000 + i] == ("" if i == 2 else f"card:{at}:{at + len(number)}")


def test_pii_mask_joins_overlaps(spark):
    rows = [(1, "call +12 345 678 901 now"), (2, None), (3, "x 4111 1111 1111 1111 y a@b.cd")]
    got = {r.doc_id: r.text for r in pii.mask(hard(spark, rows)).collect()}
    assert got == {1: "call <phone> now", 2: None, 3: "x <card> y <email>"}


# ------------------------------------------------------------------ 9 URL lists
def test_url_lists_as_of(spark):
    captures = spark.createDataFrame(
        [(1, "http://a.b.example.org/x", 5), (2, "http://a.b.example.org/x", 15),
         (3, "https://A.B.example.org:80/y", 25), (4, "http://z.b.example.org/", 25), (5, None, 3),
         (6, "http://a.b.example.org/x", None), (7, "http://a.b.example.org/x", 200),
         (7, "http://a.b.example.org/x", 200), (8, "no url", 9)],
        "page_id long, url string, fetch_day int").withColumn("key", F.lit(1)).withColumn("row", F.lit(2))
    entries = spark.createDataFrame(
        [("host", "a.b.example.org", "block", 10), ("host", "a.b.example.org", "allow", 20),
         ("host", "a.b.example.org", "block", 20), ("domain", "b.example.org", "block", 0),
         ("url", "http://a.b.example.org/x", "allow", 100), ("url", None, "block", 1),
         ("host", "a.b.example.org", "allow", None)],
        "scope string, key string, action string, day int")
    out = [(r.page_id, r.url_decision.blocked, r.url_decision.scope, r.url_decision.entry_day)
           for r in url_lists.filter_captures(captures, entries, period_days=7).collect()]
    assert sorted(out, key=str) == sorted([
        (1, True, "domain", 0), (2, True, "host", 10), (3, True, "host", 20), (4, True, "domain", 0),
        (5, False, None, None), (6, False, None, None), (7, False, "url", 100), (7, False, "url", 100),
        (8, False, None, None)], key=str)
    assert url_lists.filter_captures(captures.limit(0), entries).count() == 0
    none = url_lists.filter_captures(captures, entries.limit(0)).collect()
    assert len(none) == 9 and not any(r.url_decision.blocked for r in none)


# --------------------------------------------------------------------- 10 WARC
@pytest.mark.parametrize("split_bytes", [700, 1 << 20])
def test_warc_round_trip(spark, split_bytes):
    rnd = random.Random(12)
    noise = "".join(chr(rnd.randrange(32, 0x2000)) for _ in range(4000))
    rows = [(1, "u1", None), (2, None, ""), (3, "u 3\r\nx", "small"), (4, "u4", "small"),
            (5, "u5", "p" * 1000), (9, "u9", "p" * 1000), (7, "u7", "p" * 1000), (8, "u8", "p" * 999),
            (None, "n", noise), (10, "u10", noise), (11, "u11", "\x1f\x8b\x08WARC/1.1\r\n" * 300),
            (12, "u12", "q" * 300_000), (13, "u13", noise[::-1]), (13, "u13", noise[::-1])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string") \
        .withColumn("payload", F.lit("x")).withColumn("digest", F.lit(1)).repartition(3)
    out = warc.round_trip(pages, split_bytes=split_bytes).collect()
    assert len(out) == len(rows)
    top = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            top[html] = max(i, top.get(html, i))
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        refers = top.get(html) if top.get(html) != i else None
        want[i, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit",
             refers, None if refers is not None else data] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                    None if r.payload is None else bytes(r.payload)) for r in out) == want
    assert len({(r.path, r.position) for r in out}) == len(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_reading_tasks_grow_with_ranges(spark, monkeypatch, tmp_path):
    """With adaptive execution, ranges are not put into one task."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    used = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    folder = str(tmp_path)
    manifest = warc.write_archives(warc.plan_records(pages.repartition(2), "page_id", "html", 1000), folder)
    size = manifest.agg(F.sum("bytes")).first()[0]
    few, many = (warc.read_archives(manifest, folder, size // n + 1) for n in (2, 8))
    assert few.count() == many.count() == 300
    assert used(few) >= 2 and used(many) >= 7


def test_many_repeated_payloads(spark, monkeypatch):
    """Beyond the size of a broadcast the list of repeats is joined by digest."""
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"),
                                    F.repeat(F.concat(F.lit("x"), (F.col("id") % 7).cast("string")), 600).alias("html"))
    small = sorted(tuple(r) for r in warc.plan_records(pages, "page_id", "html", 1000)
                   .select("page_id", F.coalesce("refers_to", F.lit(-1))).collect())
    monkeypatch.setattr(warc, "SMALL_ROWS", 1)
    assert small == sorted(tuple(r) for r in warc.plan_records(pages, "page_id", "html", 1000)
                           .select("page_id", F.coalesce("refers_to", F.lit(-1))).collect())
    assert sum(r[1] == -1 for r in small) == 7


def test_warc_members_are_whole_gzip_members(tmp_path):
    import gzip
    data = b"".join(warc.record(i, "u", b"x" * i * 50, i * 50, "0", None) for i in range(20))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    assert gzip.open(path).read().count(warc.VERSION) == 20
    for cut in (1, 333, 5000):
        seen = []
        for start in range(0, len(data), cut):
            with open(path, "rb") as f:
                seen += [at for at, _ in warc.members(f, len(data), start, min(start + cut, len(data)),
                                                      piece_bytes=64, chunk=256)]
        assert len(seen) == len(set(seen)) == 20
