"""The corpus pipeline: quality, toxicity, near-duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of docs. run() applies them to the documents table, with a written table between any two stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratelens.llm import packing, quality_lm, repeat_removal, simhash_dedup, toxicity
from ratelens.llm.common import dropped_since, mark, table, written

#: Differing bits at which the pipeline links near-duplicates: of the fingerprint's 64, and of 192 further ones.
NEAR_BITS, NEAR_OF_WIDE = 10, 36


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity stays within their language's limit."""
    return quality_lm.trusted_like(docs, table(spark, sf_dir, "labels"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id.

    Fingerprints of five-word shingles: texts whose five-word shingles have a Jaccard similarity of 0.8 differ in about
    15 % of all bits, which 192 bits show with half the spread of 64. README.md has the measured shares.
    """
    return simhash_dedup.representatives(docs, radius=NEAR_BITS, shingle=5, verify=NEAR_OF_WIDE)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings that stand elsewhere too."""
    return repeat_removal.with_repeats_removed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality),
    ("toxicity", clean),
    ("simhash", one_of_each),
    ("repeats", without_repeats),
    ("packing", sequences),
]

#: SQL can't express the models and the packing; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    point = mark()
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        dropped_since(spark, point, docs)  # what the stage and the one before it have written
    return STAGES[-1][1](spark, docs, sf_dir)
