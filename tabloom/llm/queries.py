"""The corpus operators as queries over the test tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from . import bpe, imatch, langid, minhash, oracles, packing, quality, secret_scan, sharding, token_files, url_filter

BYTE_BPE = "byte_bpe_50k.json"
MULTI_BPE = "byte_bpe_multi_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir), 24)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), percent=85)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.stored_digests(_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), end=0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(_documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_documents(spark, sf_dir), public_tokenizers.path(MULTI_BPE), public_tokenizers.PATTERN)


RULES = "allow org/, block example.org/es/, block example.org/en/1, allow com/fr/, block com/de/"


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = prepare(spark).read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge_pages(pages, url_filter.parse_rules(RULES))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), end=2, most=1024)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(_documents(spark, sf_dir))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_edits(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_minhash, op3_token_files, op4_quality_rules, op5_byte_bpe, op6_url_filter, op7_language_id, op8_best_fit_packing, op9_secret_scan, op10_imatch)}


def oracle_sql() -> dict[str, str]:
    """Those that rest on trained models, tokenizers or Spark's own hashes have no SQL; tests hold them by brute force."""
    return {
        "op1_sharding": oracles.sharding_sql(24),
        "op2_minhash": oracles.near_duplicates_sql(85),
        "op4_quality_rules": oracles.quality_sql(),
        "op6_url_filter": oracles.url_sql(url_filter.parse_rules(RULES)),
    }
