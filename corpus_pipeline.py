"""The corpus pipeline: quality, near-duplicates, secrets, mix, packing.

Each stage gets what its predecessor kept, as a table it has written. All but the last
return the columns of ``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import cloudpickle  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402

import shelfwise  # noqa: E402
from shelfwise.llm import mixing, neardup, packing, quality, secrets  # noqa: E402
from shelfwise.llm.queries import TOKENIZER  # noqa: E402
from shelfwise.session import new_path  # noqa: E402

cloudpickle.register_pickle_by_value(shelfwise)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.deduplicated(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of the window's length."""
    return packing.packed(docs, *TOKENIZER)


STAGES = [
    ("quality classifier", classify),
    ("MinHash near-dedup", dedup),
    ("secret scans", redact),
    ("mixing sources", mix),
    ("packing", pack),
]

# the votes, the trees and the tokenizer have no SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"corpus-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
