"""Quality rules by a hashed n-gram likelihood ratio (operator 4).

Words and pairs of neighbouring words are hashed into ``buckets`` buckets
each. One pass over all documents counts every bucket in the whole corpus and
in the trusted target (a bounded sample of the rows labelled good), which
gives two multinomials per order, smoothed by one. A document's score is the
sum of log(target / corpus) over its words and pairs, divided by their number.
It is kept if it passes the base rules and its score reaches the threshold,
which is fixed by the target's own scores: median - slack * (median - least
quantile). The same rule holds for every document at every corpus size.

Words and pairs are exploded, looked up in the broadcast ratio table
(2 * ``buckets`` rows) and summed per document before any exchange, so a
document leaves its task as one row and texts are not shuffled. Ratios are whole ten-thousandths, so sums
do not depend on the order of rows.

Defined results: null, empty and blank texts have no words and fail the base
rule; they have no score and only the base rules decide; repeated
rows get equal results; with no labelled rows only the base rules decide;
labels of absent documents are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.common import WORD_CLASS, identity, let, lines, words, written

#: Fixed values of the base rules.
MIN_WORDS = 20
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

BUCKETS = 1 << 16
MAX_TARGET = 20_000
LEAST_QUANTILE = 0.001
SLACK = 1.5
#: Log ratios are held as whole numbers of this part.
UNIT = 10_000


@dataclass
class Model:
    ratios: DataFrame | None    # (bucket, ratio): words, then pairs
    threshold: float
    buckets: int


def grams(docs: DataFrame, text: Column, buckets: int) -> DataFrame:
    """The rows without the text, one per word and per pair of neighbours."""
    keep = [c for c in docs.columns if c != "text"]
    split = docs.select(*keep, words(text).alias("w"))
    both = split.select(*keep, F.explode(F.arrays_zip(       # the last word has no second
        F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
        .alias("b"))).alias("p"))
    one = F.pmod(F.xxhash64("p.a"), F.lit(buckets)).cast("int")
    two = F.pmod(F.xxhash64("p.a", "p.b"), F.lit(buckets)).cast("int") + buckets
    return (both.select(*keep, F.explode(F.array(one, F.when(F.col("p.b").isNotNull(), two)))
                        .alias("bucket")).where(F.col("bucket").isNotNull()))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(d, th, score) of documents (d, th, text) that have a word."""
    return (grams(docs, F.col("text"), model.buckets)
            .join(F.broadcast(model.ratios), "bucket")
            .groupBy("d", "th").agg((F.sum("ratio") / F.count(F.lit(1)) / UNIT).alias("score")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        buckets: int = BUCKETS, max_target: int = MAX_TARGET) -> Model:
    """Counts over all of ``docs``; the target is at most ``max_target``
    labelled rows with quality 1, those whose ids hash least."""
    good = (labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
            .select(F.col("doc_id").cast("long").alias("d")).distinct()
            .orderBy(F.xxhash64("d"), "d").limit(max_target))
    good = written(good, "target-ids")
    rows = docs.select(*identity(id_col, text_col), F.col(text_col).alias("text"))
    flagged = rows.join(F.broadcast(good.select("d", F.lit(1).alias("t"))), "d", "left")
    counts = (grams(flagged, F.col("text"), buckets)
              .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")))
    full = (docs.sparkSession.range(2 * buckets).select(F.col("id").cast("int").alias("bucket"))
            .join(counts, "bucket", "left").fillna(0))
    full = written(full, "gram-counts")
    order = F.col("bucket") < buckets
    sums = full.groupBy(order.alias("words")).agg(F.sum("raw").alias("raw_all"),
                                                  F.sum("target").alias("target_all"))
    ratio = (F.log((F.col("target") + 1.0) / (F.col("target_all") + buckets))
             - F.log((F.col("raw") + 1.0) / (F.col("raw_all") + buckets)))
    ratios = written(full.join(F.broadcast(sums), order == F.col("words")).select(
        "bucket", F.round(ratio * UNIT).cast("long").alias("ratio")), "gram-ratios")
    model = Model(ratios, float("-inf"), buckets)
    sample = rows.join(F.broadcast(good), "d", "left_semi")
    q = scores(sample, model).agg(F.expr(f"percentile(score, array({LEAST_QUANTILE}, 0.5))")).first()[0]
    if q is None:
        return Model(None, float("-inf"), buckets)
    return Model(ratios, q[1] - SLACK * (q[1] - q[0]), buckets)


def repeated_words(hashes: Column) -> Column:
    """Words in 8-word windows that occur twice or more in the text.

    Hashes of two, four and eight neighbouring words are built by doubling. A
    window that occurs twice repeats 7 pairs and 5 fours, so a text with fewer
    repeats of those has none and stops there."""
    def doubled(marks, by):
        n = F.greatest(F.size(marks) - by, F.lit(0))
        return F.zip_with(F.slice(marks, F.lit(1), n), F.slice(marks, F.lit(by + 1), n),
                          lambda a, b: F.xxhash64(a, b))

    def repeats(marks):
        return F.size(marks) - F.size(F.array_distinct(marks))

    def covered(starts):
        begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, begin, lambda acc, i: F.struct(
            i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
            lambda acc: acc["n"])

    def of_sorted(marks):      # (hash, start)
        same = lambda e, j: F.coalesce(F.get(marks, j)["h"] == e["h"], F.lit(False))
        twice = F.filter(marks, lambda e, j: same(e, j - 1) | same(e, j + 1))
        return let(F.sort_array(F.transform(twice, lambda e: e["i"])), covered)

    none = F.lit(0).cast("long")

    def of_eights(marks):
        ordered = F.sort_array(F.transform(marks, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(repeats(marks) == 0, none).otherwise(let(ordered, of_sorted))

    def of_fours(marks):
        return F.when(repeats(marks) < 5, none).otherwise(let(doubled(marks, 4), of_eights))

    def of_pairs(marks):
        return F.when(repeats(marks) < 7, none).otherwise(let(doubled(marks, 2), of_fours))

    return F.when(F.size(hashes) < WINDOW, none).otherwise(
        let(hashes, lambda h: let(doubled(h, 1), of_pairs)))


def duplicate_lines(text: Column) -> Column:
    full = F.filter(lines(text), lambda x: x.rlike(WORD_CLASS))
    return let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(d, th, doc_id, quality) per input row; ``quality`` holds the base
    counts, base_failed, score and kept."""
    rows = docs.select(*identity(id_col, text_col), F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = (rows.select("*", words(F.col("text")).alias("w")).select(
        "d", "th", "doc_id", F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.transform("w", lambda x: F.xxhash64(x))).alias("n_repeat_words")))
    if model.ratios is None:
        counted = counted.withColumn("score", F.lit(None).cast("double"))
    else:
        counted = counted.join(scores(rows.drop("doc_id"), model), ["d", "th"], "left")
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= model.threshold, F.lit(True))
    return (counted.withColumn("base_failed", failed).withColumn("kept", kept)
            .select("d", "th", "doc_id",
                    F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                             "base_failed", "score", "kept").alias("quality")))


def keep_good(docs: DataFrame, model: Model, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The input's rows that are kept, with its columns."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    good = judge(docs, model, id_col, text_col).where("quality.kept").select("d", "th").distinct()
    return (docs.select(row, *identity(id_col, text_col)).join(good, ["d", "th"], "left_semi")
            .select(*[F.col("__row")[c].alias(c) for c in docs.columns]))
