"""A training corpus from ``documents``: language, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes all rows that the stage before kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointset.llm import decontamination, jaccard_join, language_id, substring_dedup
from pointset.llm.common import id_back, read, shared_dir
from pointset.llm.queries import pack_documents


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: those without a letter, and those of which the network is not sure."""
    return language_id.keep_identified(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity of 0.8 or more, over any number of links) the smallest id stays."""
    return jaccard_join.keep_one(docs, words=5, similar=(80, 100))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out of each text what a hundred bytes or more repeat from earlier on; n_chars follows the text."""
    cut = substring_dedup.dedup(docs)
    n = F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return cut if n is None else cut.withColumn("n_chars", n)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    out = pack_documents(docs)
    return out.select(id_back("doc_key").alias("doc_id"), *[c for c in out.columns if c != "doc_key"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("near_duplicates", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Networks, suffix indexes and packing are beyond SQL; tests/llm hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
