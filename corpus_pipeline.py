"""A corpus pipeline over the documents table: each stage's rows are written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpair.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from docpair.llm.queries import toxicity_model, vocabulary
from docpair.llm.shared import discarded, freed, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents predicted toxic, by a model learned from the labels table of sf_dir.

    Null and empty texts have no hit and stay. Equal texts are judged alike; repeated rows stay or go together.
    """
    return toxicity.with_toxicity(docs, toxicity_model(spark, sf_dir)).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With lines dropped that other documents repeat; n_chars follows the text.

    No row goes. Null texts become empty ones. Of documents that share a line, the one with the largest id keeps it; a
    null id is smaller than any other. Rows that repeat an id are one document.
    """
    freed(spark)  # shuffle files of the stage before
    out = line_dedup.drop_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one document of each group of near duplicates: the one with the smallest id.

    Documents without words are near duplicates of none and stay. Rows that repeat an id are one document: they stay
    together if the id is its group's smallest. Rows with a null id stay if their group has no other ids.
    """
    freed(spark)
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With documents repeated or left out, so that sources come near their targets.

    A copy is an equal row. Null sources are a source of their own. Documents without words have nothing to add, but are
    drawn like others of their source; sources without words at all go.
    """
    freed(spark)
    return mixing.mix_sources(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the ids of each text, their number, and the digest of the text that is decoded from them. Null texts are empty ones, without ids."""
    freed(spark)
    return bpe.encode_and_decode(docs.select("doc_id", "source", "lang", "text"), vocabulary()).select("doc_id", "source", "lang", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("mixing", mix), ("bpe", to_tokens)]
#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the documents table. A stage's table is deleted once the next is written; the last one stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            discarded(spark, before)
        before = f"{folder}/{name}"
    return docs
