"""The queries of this subpackage: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, langid, licenses, line_templates, mixing, secret_scan, sharding, simhash, suffix_tree
from .common import small_batches, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_next(table(spark, sf_dir, "documents"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", licenses.scan(F.col("text")).alias("r")).select("doc_id", "r.*")


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.dedup_lines(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents")).drop("_row")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.drop("_row", "longest_hit")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_classes(table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", secret_scan.scan(F.col("text")).alias("r")).select("doc_id", "r.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_suffix_tree, op3_licenses, op4_line_templates, op5_mixing, op6_sharding, op7_langid, op8_decontaminate, op9_simhash, op10_secrets)}


def oracle_sql() -> dict[str, str]:
    return {"op8_decontaminate": decontaminate.SQL}
