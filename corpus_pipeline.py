"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, token files.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents.  ``run`` applies them to the documents table.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinrank.llm import decontaminate, mixing, near_dedup, quality, token_files
from kinrank.plans.context import drop_tables, shared_dir, tables

#: The vocabulary file, as every worker finds it.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; kept ones lose their boilerplate lines."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, 0.8)."""
    return near_dedup.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics meet their targets."""
    return mixing.sample(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files are written; returned is what they read back as, per document."""
    return token_files.encode(docs, f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}", TOKENIZER)


_left: dict[str, frozenset[str]] = {}


def _tidy(stage: Callable) -> Callable:
    """A stage's result is written before the next stage begins, so the tables
    that the stage before left in the shared folder can go."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        drop_tables(spark, _left.pop(app, frozenset()))
        before = tables(spark)
        out = stage(spark, docs, sf_dir)
        _left[app] = tables(spark) - before
        return out

    return run_stage


STAGES = [
    ("quality_rules", _tidy(quality_rules)),
    ("near_duplicates", _tidy(near_duplicates)),
    ("decontamination", _tidy(decontamination)),
    ("source_mixing", _tidy(source_mixing)),
    ("token_output", _tidy(token_output)),
]

#: Raking is iterative and tokenizing is no SQL: tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
