"""From raw documents to token ids: language ID, near duplicates, repeated passages, benchmark, BPE.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; its result is written
as Parquet and read again. A stage returns the columns of its input, whatever else they hold, the last one digests of
the token ids. Texts may be null, empty or very long and rows may repeat: the first stage drops texts without letters,
the second groups of near duplicates without any doc_id and all but one row of each other group. Empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import op01_bpe, op02_decontamination, op04_language_id, op05_substring_dedup, op09_simhash
from palimpsest.llm.common import scratch_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach; null texts and texts without letters go."""
    models = op04_language_id.train(docs.where(~op04_language_id.held_out()))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")  # whatever their columns are called
    return op04_language_id.identify(rows, models, keep=["row"]).where("NOT rejected").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id; two texts under one doc_id are two documents."""
    return op09_simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words that a document of smaller doc_id holds in the same 13 words; n_chars follows the text."""
    cleaned = op05_substring_dedup.drop_repeats(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return op02_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, digest of the ids and of what they decode to, for each document."""
    return op01_bpe.digests(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", token_ids),
]

#: SQL cannot express the models and trees of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written under the shared checkpoint folder."""
    folder = f"{scratch_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
