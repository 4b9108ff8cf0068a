"""The corpus pipeline: language, quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; it is written as Parquet and read again before the next. The first four
return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import langid, minhash, packing, quality, secret_scan
from tabloom.llm.common import new_dir
from tabloom.session import prepare


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or rejected by all models, go."""
    return langid.keep_identified(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a fence of their language and source go."""
    return quality.keep_documents(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.keep_first(docs, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; documents stay."""
    return secret_scan.mask_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. Fewer chunks are remembered than alone: executors are near their memory here."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end=2, most=1024, kept=100_000)


STAGES = [
    ("language ID", language),
    ("quality rules", good),
    ("near-duplicates", distinct),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: The models of the first and fourth stage are trained; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = new_dir(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
