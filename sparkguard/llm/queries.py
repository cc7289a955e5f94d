"""The registered queries op1_ to op13_, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir
from . import bfd_packing, config_packing, decontamination, embedding_dedup, langid, lexical_search, license_scan, merkle, near_dedup, quality, secret_scan, substring_dedup, warc
from .common import materialize, read


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "matrix")
    bfd_packing.write_packed(bfd_packing.pack(read(spark, sf_dir, "documents")), path)
    return bfd_packing.digest(spark.read.parquet(path))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(materialize(substring_dedup.kept_texts(read(spark, sf_dir, "documents")), "kept"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_packing.pack(read(spark, sf_dir, "documents"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(read(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_packed_rows, op3_language_id, op4_license_scan, op5_substring_dedup, op6_decontamination, op7_embedding_near_duplicates, op8_secret_scan, op9_best_fit_packing, op10_warc_round_trip, op11_quality, op12_merkle_manifest, op13_ranked_search)}
#: Others can't be expressed in SQL; tests/llm compares them with brute force.
ORACLE_SQL = {"op4_license_scan": license_scan.oracle_sql(), "op6_decontamination": decontamination.ORACLE_SQL, "op7_embedding_near_duplicates": embedding_dedup.ORACLE_SQL, "op10_warc_round_trip": warc.ORACLE_SQL, "op12_merkle_manifest": merkle.oracle_sql(), "op13_ranked_search": lexical_search.ORACLE_SQL}
