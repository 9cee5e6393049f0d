"""The corpus pipeline, stage by stage, against brute-force versions."""
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from fraudlens.llm import quality
from fraudlens.llm.common import load, written
from test_operators import (PLAIN, WORD, base_counts, hard, kept_lines, linked_components,
                            plain_spans)

P = pytest.importorskip("public_tokenizers")


def signed(h):
    return h - 2 ** 64 if h >= 2 ** 63 else h


def buckets_of(text, buckets):
    """Spark's xxhash64 of words and pairs (seed 42, columns chained)."""
    words = [w.encode() for w in WORD.findall(text or "")]
    one = [xxhash.xxh64_intdigest(w, 42) for w in words]
    two = [xxhash.xxh64_intdigest(b, h) for h, b in zip(one, words[1:])]
    return [signed(h) % buckets for h in one] + [signed(h) % buckets + buckets for h in two]


def verdicts(rows, good, buckets=quality.BUCKETS):
    """id -> kept, by the rule in words of the module."""
    grams = {i: buckets_of(t, buckets) for i, t in rows}
    raw, target = np.zeros(2 * buckets), np.zeros(2 * buckets)
    for i, own in grams.items():
        np.add.at(raw, own, 1)
        if i in good:
            np.add.at(target, own, 1)
    ratio = np.zeros(2 * buckets)
    for part in (slice(0, buckets), slice(buckets, 2 * buckets)):
        t = np.log((target[part] + 1) / (target[part].sum() + buckets))
        r = np.log((raw[part] + 1) / (raw[part].sum() + buckets))
        ratio[part] = np.round((t - r) * quality.UNIT)
    scores = {i: ratio[own].sum() / len(own) / quality.UNIT for i, own in grams.items() if own}
    q = np.percentile([scores[i] for i in good if i in scores], [100 * quality.LEAST_QUANTILE, 50])
    limit = q[1] - quality.SLACK * (q[1] - q[0])
    return {i: not base_counts(t)[-1] and scores.get(i, math.inf) >= limit for i, t in rows}


def masked(text):
    spans = [x.split(":") for x in plain_spans(text).split(",") if x]
    out, at = [], 0
    for kind, a, b in spans:
        a, b = int(a), int(b)
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_stages_equal_brute_force(spark):
    from tokenizers import Tokenizer
    stages = dict(corpus_pipeline.STAGES)
    docs = load(spark, SF_SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    good = {r.doc_id for r in load(spark, SF_SMALL, "labels").where("quality = 1").collect()}
    columns = docs.columns

    def step(name, want):
        nonlocal docs
        docs = written(stages[name](spark, docs, SF_SMALL), "test-stage")
        assert docs.columns == columns
        got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
        assert {i: t for i, (t, _) in got.items()} == dict(want)
        assert all(n == len(t) for t, n in got.values())
        return list(want)

    keep = verdicts(rows, good)
    rows = step("quality rules", [(i, t) for i, t in rows if keep[i]])
    assert 100 < len(rows) < 200
    rows = step("line dedup", [(i, t) for i, _, _, t in kept_lines(rows)])
    parts = linked_components(rows, 4, 5, 5)
    least = {doc for doc, _, c in parts if doc == c}
    rows = step("near-dedup", [(i, t) for i, t in rows if i in least])
    rows = step("personal data", [(i, masked(t)) for i, t in rows])
    assert not any(re.search(PLAIN["email"], t) for _, t in rows)
    packed = stages["packing"](spark, docs, SF_SMALL).collect()
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    want = Counter()
    for i, t in rows:
        ids = own.encode(t, add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[i, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    assert corpus_pipeline.run(spark, SF_SMALL).count() == len(packed)


def test_stages_on_hard_inputs(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns, no rows."""
    for rows in (None, []):
        docs = hard(spark) if rows is None else hard(spark, rows)
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_SMALL)
            if name != "packing":
                assert out.columns == docs.columns
            assert (out.count() > 0) == (rows is None)
