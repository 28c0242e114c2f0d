"""The registered queries of this package: operators over their whole tables, with production parameters."""

from __future__ import annotations

import os

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chroma, chunks, decontam, langid, packing, quality, rans, sharding, simhash, wrappers

TOKENIZERS = os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rans_token_files(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return rans.encode_and_read_back(_table(spark, sf_dir, "documents"), f"{tokenizers}/word_bpe_49k.json", end_id=1)


SHARD_BYTES = 1 << 20


def op2_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op3_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: every vector of `embeddings` is rendered as a recording of 64 notes."""
    return chroma.matches(chroma.fingerprints(chroma.rendered(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "id", "pcm"))


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), f"{tokenizers}/byte_bpe_50k.json", end_id=0, capacity=2048)


def op6_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(_table(spark, sf_dir, "documents"))


def op7_wrapper_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(_table(spark, sf_dir, "pages"))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_rans_token_files, op2_extendible_shards, op3_chroma_fingerprints, op4_simhash_golay, op5_best_fit_packing, op6_gear_chunks, op7_wrapper_main_text, op8_language_mixture, op9_quality_discriminant, op10_seed_alignment)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE_SQL: dict[str, str] = {"op2_extendible_shards": sharding.oracle(SHARD_BYTES)}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
