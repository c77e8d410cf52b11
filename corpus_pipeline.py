"""From raw documents to token ids: toxic documents, near copies and benchmark leaks go, personal
numbers become pseudonyms, and what is left is encoded.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of ``documents``. ``run`` writes each stage as Parquet to the shared folder.

Edge cases: a null text counts as empty in every stage; texts without words share the fingerprint zero, so one of them
stays. Rows with a null id are judged by their text and are never dropped as copies, as they cannot be told apart. Rows
that repeat an id count as one document in the near-duplicate stage, which keeps one of them. Extra columns go through
all stages; those named ``__made`` or ``__replaced`` clash with columns made here. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from blockquorum.llm import bpe, decontaminate, pseudonyms, simhash, toxicity
from blockquorum.llm.common import table
from blockquorum.llm.queries import PSEUDONYM_KEY
from blockquorum.runtime import materialize


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows of the table itself."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, stays of each SimHash component."""
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_numbers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers and dates become pseudonyms; ``n_chars`` follows the text where it changed."""
    made = pseudonyms.pseudonymise(docs, PSEUDONYM_KEY, count_col="__replaced")
    n_chars = F.when(F.col("__replaced") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return made.withColumn("n_chars", n_chars).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids (little-endian unsigned 32-bit), and checksums of these and of what they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=docs.columns)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_numbers", personal_numbers),
    ("token_ids", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
