"""The queries opN_<name> and their SQL. Each applies its operator, with production
parameters, to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_clusters, chat, decontam, html_extract, langid, media, merkle, mixing, ngram_join, oracles, sharding, substring, suffix, topk_search
from .common import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    run.__doc__ = f.__doc__
    QUERIES[f.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op3_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(_table(spark, sf_dir, "documents"))


@_query
def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`: the leaves' sizes are near equal."""
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the NPY tile of each image as the last column."""
    return media.text_payload_images(_table(spark, sf_dir, "documents")).drop("media").withColumnRenamed("dhash", "feature")


@_query
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents")).drop("k1", "k2")


@_query
def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


ORACLE_SQL["op9_chat_snapshots"] = chat.FORMAT_SQL


@_query
def op1_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_runs(_table(spark, sf_dir, "documents"))


@_query
def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("k1", "k2")


@_query
def op4_ipf_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.withColumn("p", F.round("p", 9)).drop("u")


@_query
def op10_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


@_query
def op2_gbt_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@_query
def op11_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_clusters.cluster_documents(_table(spark, sf_dir, "embeddings"))


@_query
def op12_tiled_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all vectors."""
    return topk_search.search_every(_table(spark, sf_dir, "embeddings"))


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


ORACLE_SQL |= {"op5_spaced_seeds": oracles.DECONTAM, "op6_kd_shards": oracles.shards_sql(), "op7_media_columns": oracles.IMAGES, "op8_ngram_join": oracles.NEAR_DUPLICATES, "op10_bwt_repeats": oracles.REPEATS}
ORACLE_SQL |= {"op11_ball_tree_clusters": oracles.clusters_sql(), "op12_tiled_top_k": oracles.TOP_K, "op13_merkle_manifest": oracles.manifest_sql()}
