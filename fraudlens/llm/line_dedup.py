"""Repeated-line removal with keep bitmaps (operator 2).

Every line of at least ``min_chars`` code points becomes one small row
(document, line number, 128-bit hash of its key); no text is shuffled to find
repeats. Rows are range-partitioned by hash and sorted by hash, document
(descending) and line number, and each hash's run is streamed: the first
document of the run keeps its lines, later documents lose theirs if the run
has at least ``min_docs`` documents. The result is a compressed keep bitmap
per document: 64-bit words, only those with a dropped line.

Hot lines: a hash with more than rows / 4096 rows (and over ``hot_floor``) is
not streamed; at most 4096 hashes can have so many, so the list of them and
its decisions (document count, largest document) are broadcast and decide the
rows where they lie. Every other run is bounded by that same number.

Defined results: null or empty text is one empty line; a null document id
counts as one document, smaller than all others; repeated rows of the same id
are one document; extra columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fraudlens.llm.common import SPACES, identity, let, lines, lower_ascii, written

MAX_HOT = 4096


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    key = F.btrim(F.col("line"), F.lit(SPACES))
    return (docs.select(*identity(id_col, text_col),
                        F.posexplode(lines(lower_ascii(F.col(text_col)))).alias("at", "line"))
            .select("d", "th", "at", key.alias("key"))
            .where(F.char_length("key") >= min_chars)
            .select("d", "th", "at", F.xxhash64("key").alias("h1"),
                    F.xxhash64(F.lit("second"), F.col("key")).alias("h2")))


def dropped_lines(keys: DataFrame, min_docs: int, hot_floor: int) -> DataFrame:
    """(d, th, at) of every line to drop."""
    limit = max(hot_floor, keys.count() // MAX_HOT)
    hot = keys.groupBy("h1", "h2").count().where(F.col("count") > limit).select("h1", "h2")
    hot_docs = (keys.join(F.broadcast(hot), ["h1", "h2"]).select("h1", "h2", "d").distinct()
                .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"),
                                         F.max("d").alias("top")))
    hot_docs = written(hot_docs, "hot-lines")
    of_hot = (keys.join(F.broadcast(hot_docs), ["h1", "h2"])
              .where((F.col("n_docs") >= min_docs) & (F.col("d") < F.col("top"))))

    cold = keys.join(F.broadcast(hot_docs.select("h1", "h2")), ["h1", "h2"], "left_anti")
    order = [F.col("h1"), F.col("h2"), F.col("d").desc(), F.col("at")]
    runs = cold.repartitionByRange("h1", "h2").sortWithinPartitions(*order)
    run = W.partitionBy("h1", "h2")
    stream = run.orderBy(F.col("d").desc(), F.col("at"))
    of_cold = (runs.withColumn("first", ~F.lag("d").over(stream).eqNullSafe(F.col("d")))
               .withColumn("n_docs", F.sum(F.col("first").cast("int")).over(run))
               .withColumn("top", F.max("d").over(run))
               .where((F.col("n_docs") >= min_docs) & (F.col("d") < F.col("top"))))
    return of_hot.select("d", "th", "at").unionByName(of_cold.select("d", "th", "at"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = 20, min_docs: int = 3, hot_floor: int = 1024) -> DataFrame:
    """(d, th, keep) for documents that lose lines; ``keep`` is a sorted
    array of (word, bits), bit i of word w telling whether line 64 w + i
    stays. Words that are absent keep all their lines."""
    keys = written(line_keys(docs, id_col, text_col, min_chars), "line-keys")
    word, bit = F.floor(F.col("at") / 64).cast("int"), (F.col("at") % 64).cast("int")
    one = F.lit(1).cast("long")
    return (dropped_lines(keys, min_docs, hot_floor)
            .groupBy("d", "th", word.alias("word"))
            .agg(F.bitwise_not(F.bit_or(F.call_function("shiftleft", one, bit))).alias("bits"))
            .groupBy("d", "th").agg(F.sort_array(F.collect_list(F.struct("word", "bits")))
                                    .alias("keep")))


def kept_text(text: Column, keep: Column) -> Column:
    """The text without the lines that the bitmap drops."""
    def stays(marks):
        def test(_, i):
            bits = F.try_element_at(marks, F.floor(i / 64).cast("int"))
            bit = F.call_function("shiftright", bits, (i % 64).cast("int")).bitwiseAND(F.lit(1))
            return F.coalesce(bit == 1, F.lit(True))
        return test
    filtered = let(F.map_from_entries(keep), lambda m: F.concat_ws("\n", F.filter(lines(text), stays(m))))
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(filtered)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                **how) -> DataFrame:
    """The input's rows and columns plus ``line_report``: n_lines, n_dropped
    and the remaining text."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    marks = keep_bitmaps(docs, id_col, text_col, **how).withColumnRenamed("keep", "__keep")
    text = F.col("__row")[text_col]
    gone = F.aggregate(F.coalesce(F.col("__keep"), F.array().cast("array<struct<word:int,bits:bigint>>")),
                       F.lit(0).cast("long"),
                       lambda n, x: n + F.lit(64).cast("long") - F.bit_count(x["bits"]))
    report = F.struct(F.size(lines(text)).cast("long").alias("n_lines"), gone.alias("n_dropped"),
                      kept_text(text, F.col("__keep")).alias("text"))
    return (docs.select(row, *identity(id_col, text_col)).join(marks, ["d", "th"], "left")
            .select(*[F.col("__row")[c].alias(c) for c in docs.columns],
                    report.alias("line_report")))
