"""From raw documents to packed sequences: five stages, each written and read again by whoever runs them.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns the documents that stay, with their columns, and the last one the
packed pieces.  Every stage works on all rows that it gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgate.llm import language_id, near_dedup, packing, quality_rules, substring_dedup
from crawlgate.llm.common import prefixed, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    p = prefixed(docs.columns)
    judged = docs.withColumn(p + "verdict", quality_rules.verdict())
    return judged.filter(F.col(p + "verdict")["kept"]).drop(p + "verdict")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin, learnt from the labelled ones among them."""
    p = prefixed(docs.columns)
    predict = language_id.predictor(spark, language_id.learn(docs))
    found = docs.withColumn(p + "found", predict(F.col("text")))
    return found.filter(~F.col(p + "found")["rejected"]).drop(p + "found")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one that comes first."""
    return near_dedup.dedupe(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated strings; ``n_chars`` follows the text, and emptied ones stay, empty."""
    return substring_dedup.dedupe(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces placed in sequences of 1024 tokens."""
    return packing.packed(packing.pieces(docs))


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("minmax_dedup", near_duplicates),
    ("suffix_dedup", repeated_substrings),
    ("best_fit_packing", pack),
]

#: Compression, minimum hashes and tokens are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
