"""Registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlib.llm import chat, decontaminate, fingerprints, licenses, mixing, neardup, negatives, neighbours, passages, quality, shards, spelling, tokens
from flowlib.llm.arrays import small_batches
from flowlib.scratch import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op2_decontamination": decontaminate.SQL,
    "op3_mixing": mixing.SQL,
    "op10_chat_perspectives": chat.SQL,
    "op11_hard_negatives": negatives.SQL,
}
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
TOKEN_LIMIT = 1024
BASE_LICENSES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def query(name: str):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


@query("op3_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op5_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


@query("op6_licenses")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), BASE_LICENSES).drop("detections")


@query("op7_near_duplicates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def sequence_rows(docs: DataFrame) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder; one row per sequence, read back from the files."""
    spark = docs.sparkSession
    target = new_path(spark, "shards")
    shards.write_shards(docs, target, public_tokenizers.path(RANKS))
    return shards.read_shards(spark, target).withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids")


@query("op8_token_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_rows(table(spark, sf_dir, "documents"))


@query("op9_passages")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.removal(table(spark, sf_dir, "documents"))


@query("op10_chat_perspectives")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


@query("op11_hard_negatives")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_neighbours")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))
