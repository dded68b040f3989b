"""The queries of this subpackage over the driver's tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, embedding_links, html_text, language_id, mixing, pseudo_likelihood, sharding, simhash, substring_dedup, telephony


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.telephony_digest(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digest(_table(spark, sf_dir, "documents"))


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_digest(_table(spark, sf_dir, "documents"))


def op6_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(_table(spark, sf_dir, "documents"))


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_telephony_media, op2_substring_dedup, op3_simhash_neardup, op4_ppm_language, op5_byte_bpe,
        op6_subspace_pigeonhole, op7_html_main_text, op8_mix_sources, op9_rendezvous_shards, op10_pseudo_likelihood,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op8_mix_sources": mixing.ORACLE_SQL, "op9_rendezvous_shards": sharding.ORACLE_SQL}
