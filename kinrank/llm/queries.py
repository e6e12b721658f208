"""Registered queries of the training-data operators.

Each applies one operator, with production parameters, to its whole table
and returns the columns that its contract names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinrank.llm import (
    chat, decontaminate, filter_audit, line_dedup, mixing, near_dedup, pii, quality, sharding, substring_dedup,
    token_files, url_filter, whitening,
)
from kinrank.plans.context import materialize, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.assess(docs, keep_text=False).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", F.col("removed_words").cast("long").alias("removed_words"),
    )


@query
def op1_minhash_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.assign(docs, words=4).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op8_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))


@query
def op5_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mixing.assign(docs).select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"),
        F.round("probability", 9).alias("probability"), F.round("loss_weight", 9).alias("loss_weight"), "sampled",
    )


@query
def op4_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    return token_files.encode(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))


#: A conversation with control strings in its texts, added to the table by the contract.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


@query
def op3_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.digest(materialize(chat.examples(rows.unionByName(control))))


@query
def op7_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.assess(docs).select(
        "doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines",
        F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("clean_sha256"),
    )


@query
def op2_pii(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of("base", kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        F.col("row.doc_id").alias("doc_id"), *counts,
        F.sha2(pii.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.spans_text(F.col("spans")).alias("spans"),
    )


#: The rules of the contract.
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


@query
def op6_url_filter(spark, sf_dir):
    """A page's url carries the number of its document; toxic or low-quality
    documents label their urls as block."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("label"))
    number = F.regexp_extract(url_filter.path_of(F.col("url")), "/([0-9]{1,18})", 1).try_cast("long")
    labelled = pages.withColumn("doc_id", number).join(bad, "doc_id").select("url", "label")
    return url_filter.judge(pages, labelled, URL_RULES).withColumn("score", F.round("score", 6))


@query
def op11_filter_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


@query
def op12_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring_dedup.assess(docs, keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op13_whitening(spark, sf_dir):
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))
