"""A corpus cleaning pipeline over documents; part of the training-data subpackage.

In every stage: rows with a null doc_id or a null or empty text match nothing and stay, and are packed as a single end
token where they have no text; rows that repeat a doc_id count as one document and stay or go together, but are scored
for toxicity each by its own text; an empty table gives an empty table. Extra columns pass through all stages but the
last; names that begin with two underscores are taken.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dialoom.llm import decontaminate, line_dedup, near_dup, packing
from dialoom.llm import toxicity as toxic
from dialoom.llm.common import delete, materialize, recorded, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Words whose ids a worker keeps in the last stage, whose executors hold what earlier stages left.
CACHED_WORDS = 150_000
#: Tables that the stage called last wrote on the way; its result reads them.
LEFT: list[tuple[SparkSession, str]] = []


def tidy(stage: Stage) -> Stage:
    """stage, which first deletes what the stage before it wrote on the way. It is called when that one's result is
    written; no other table is touched."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        while LEFT:
            delete(*LEFT.pop())
        with recorded() as written:
            out = stage(spark, docs, sf_dir)
        LEFT.extend(written)
        return out

    return run_stage


@tidy
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    return toxic.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@tidy
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, and so do documents that lose all their words by it."""
    return line_dedup.dedup_lines(docs, emptied=False)


@tidy
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dup.keep_one_of_each(docs)


@tidy
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cached=CACHED_WORDS)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: SQL expresses neither the trained grammar, the signatures, the tiling nor the bin packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over what the one before it kept, written to the shared folder in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
