"""The corpus pipeline: documents in, packed training sequences out, one written table per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantledger.llm.byte_cnn import drop_unidentified, fitted, least_score
from plantledger.llm.chunk_recipes import drop_exact_duplicates
from plantledger.llm.common import written
from plantledger.llm.exact_packing import pack
from plantledger.llm.queries import held_out, tokenizer_path
from plantledger.llm.secret_index import redact_secrets
from plantledger.llm.shingle_join import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, texts without a letter, texts that no language scores high enough for)
    go; all columns and other rows stay as they are.

    The network is trained on a bounded sample of the labelled rows that are not held out. If none is labelled, no
    language is known and every text with a letter stays. The score that is high enough is measured on held-out rows.
    """
    model = fitted(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return drop_unidentified(docs, model, least=least_score(model, docs.where(held_out())))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts stays: the longest as written, then the smallest doc_id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts stays, the one with the smallest doc_id."""
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark, n_chars follows; every document stays, and those without secrets stay as they are."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its sequence and place there."""
    return pack(docs, tokenizer_path()).withColumnRenamed("_id", "doc_id")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing)]

#: Language identification is a trained model and packing is a search, so no SQL states the rows of ``run``.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
