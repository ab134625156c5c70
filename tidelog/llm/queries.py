"""The registered queries of this folder, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import table
from .dart_minhash import near_duplicates
from .gam_quality import quality_scores
from .jpeg_media import media_columns
from .kd_shards import kd_shards
from .license_rules import license_scan
from .pca_dedup import near_vectors
from .sentencepiece_bpe import sentencepiece_round_trip
from .source_mix import mix
from .token_counts import token_counts
from .warc import warc_archive


def op1_pca_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_round_trip(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"))


def op9_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = [op1_pca_dedup, op2_gam_quality, op3_source_mix, op4_license_scan, op5_dart_minhash, op6_sentencepiece, op7_warc, op8_kd_shards, op9_jpeg_media, op10_token_counts]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pca_dedup": oracles.near_vectors_sql(),
        "op4_license_scan": oracles.license_sql(),
        "op5_dart_minhash": oracles.near_duplicates_sql(),
        "op7_warc": oracles.warc_sql(),
    }
