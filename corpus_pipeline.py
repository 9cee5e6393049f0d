"""Corpus preparation: documents to packed token sequences in five stages.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its
predecessor kept. Between stages the rows are written as Parquet to the shared
folder and read again, so a lost executor costs one stage's tasks at most.
Nulls, empty texts, repeated rows and extra columns are treated as each
operator's module says; extra columns pass through to the fourth stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.llm import line_dedup, near_dedup, packing, pii, quality
from fraudlens.llm.common import load, written
from fraudlens.llm.registered import token_pattern, vocabulary


def with_text(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """The given columns with a new text and, if there, its length."""
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return docs.select(*[new.get(c, F.col(c)).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the likelihood ratio keep."""
    return quality.keep_good(docs, quality.fit(docs, load(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that later documents hold; a text whose lines
    all go stays as an empty one."""
    return with_text(line_dedup.dedup_lines(docs), docs.columns, F.col("line_report.text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at 0.8, the one of
    the least id."""
    return near_dedup.keep_one(docs, num=4, den=5, width=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask(docs)
    return with_text(masked, docs.columns, F.col("text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), token_pattern())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Hashed ratios and token ids have no SQL form; tests compare run() with a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
