"""The registered queries of the operators; columns follow the contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language_id, licenses, mixing, sharding, simhash, spelling, substrings, suffixes, syncmers, token_counts, topk, turns
from .common import documents


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_edits(documents(spark, sf_dir))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def op4_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(documents(spark, sf_dir), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    return topk.top_k(table, table.filter("vec_id % 20 = 0"), k=20)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("crc")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", language_id.held_out())
    model = language_id.fit(docs, train=~F.col("held_out"))
    return language_id.predict(docs, model, keep=("doc_id", "held_out"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(documents(spark, sf_dir), budget=4096)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "cut_chars")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_bpe, op2_syncmers, op3_substrings, op4_shard_documents, op5_suffixes, op6_topk, op7_simhash, op8_mixing, op9_language_id, op10_token_counts)
    return {f.__name__: f for f in (*numbered, op11_spelling, op12_licenses, op13_conversations)}


def oracle_sql() -> dict[str, str]:
    return {"op12_licenses": licenses.oracle_sql()}
