"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the
last the columns of ``documents``.  ``run`` writes what a stage keeps to the
shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import arrays, mixing, packing, queries, secret_scan, simhash, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    arrays.visible(spark)
    return toxicity.reject(docs, toxicity.train(docs, queries.toxic_labels(spark, sf_dir), queries.TOXIC_CHAIN))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all others."""
    arrays.visible(spark)
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kinds."""
    arrays.visible(spark)
    return secret_scan.redact(docs, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    arrays.visible(spark)
    return mixing.mixture(docs, weights=queries.MIX_WEIGHTS, limit=queries.MIX_LIMIT, seed=queries.MIX_SEED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    arrays.visible(spark)
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mix), ("packing", pack)]

#: No SQL: the stages train a classifier, follow links and search for fillings.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = queries.table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            last = path
            docs, path = arrays.stored(docs)
            if last:
                arrays.dropped(spark, last)
    return docs
