"""From documents to packed training sequences, in stages that each read what the one before it wrote."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from metrolith.llm import chunks, decontam, langid, near, packing
from metrolith.llm.common import remove, work_folder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a language of at least half their words; null texts go."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group linked by similarity 0.8 or more of five-word shingles; all
    rows of that id, if it is repeated, and all rows of a null id."""
    return near.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of over 50 words that a document of a smaller id holds; a document of nothing else goes."""
    return chunks.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark, rows of a null id too."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids; a null text is its end id alone."""
    return packing.pack_documents(docs, TOKENIZER, keep=100_000)


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack_sequences),
]

#: SQL can express none of the stages; tests/llm holds run() to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. A stage's folder goes once the next one is written. An empty table gives no row; columns beyond
    those of documents are carried to the last stage, whatever their names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        folder = work_folder(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)
        before = folder
    return docs
