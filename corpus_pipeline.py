"""The corpus pipeline: what is left of ``documents`` after five stages, encoded.

1. ``language``: documents in no known language go.
2. ``near_dedup``: of near-duplicate documents, linked from ``NEAR`` hundredths of similarity on, the one with the smallest id
   stays.
3. ``decontamination``: documents that hold a benchmark item go.
4. ``personal_data``: personal data in the texts is replaced by its kind; ``n_chars`` follows.
5. ``encoding``: every remaining text is encoded and decoded; ids and decoded bytes are reported by their digests.

Each stage works on all rows its predecessor kept. Nulls, empty texts, repeated rows and empty tables are treated as the
operators' docstrings say. The stages have no SQL twin; tests compare them with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import bpe, decontam, language, near_dedup, pii
from sparkwarden.llm.blocks import share
from sparkwarden.llm.queries import ranks_path
from sparkwarden.session import ensure_checkpoint_dir

#: Below the 85 of op2_near_duplicates, whose threshold is fixed by its own contract.
NEAR = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.drop_rejected(docs, ~share(F.col("doc_id"), 2, 4) & F.col("doc_id").isNotNull())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, least=NEAR)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, ranks_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", redact_personal_data),
    ("encoding", encode_texts),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage keeps is cut off by a checkpoint, so the next one starts from files."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
