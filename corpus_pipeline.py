"""The corpus pipeline: classify, dedup exactly, dedup nearly, mix, pack.

Each stage takes all that its predecessor kept; all but the last return the columns of documents. A stage's result
is written as Parquet in the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import exact_dedup, mixing, packing, quality, simhash
from recordloom.llm.common import fresh_path, materialize, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the largest id stays."""
    index = exact_dedup.DigestIndex.for_rows(spark, fresh_path(spark, "digest-index"), docs.count())
    kept = exact_dedup.keep_first(docs, index, "corpus")
    index.forget()
    return kept


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (by fingerprints, and a similarity of 0.8 of five-word shingles), the smallest id stays."""
    return simhash.keep_dissimilar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by probabilities raked to the source, language and topic targets."""
    return mixing.keep_sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", classify), ("exact dedup", dedup_exact), ("SimHash near-dedup", dedup_near), ("mixing", mix), ("packing", pack)]

#: SQL has neither the classifier nor XXH64 fingerprints nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
