"""Sharding by longest-processing-time scheduling of groups.

Documents with equal texts stay together.  Groups are sorted by size, largest
first, and each goes to the shard with the least bytes so far, kept in a heap.

The heap works on a bounded number of items, whatever the corpus: a group of
at least ``1 / (shards * FINE)`` of all bytes (at most ``shards * FINE`` of
them) is its own item; smaller groups are dealt by hash into ``shards * FINE``
bundles, each an item.  Loads then differ by about one small item, or by what
one group larger than a whole shard's share forces.  Only these items reach
the driver, and their shards go back as a broadcast of the same bound.

Law: ``bytes``.  Slots number the documents of a shard from 0 without gaps, by
a distributed row number (range partitions, no task per shard).

Defined results: a null text has size 8 and crc 0 and groups with empty
texts; null ids and repeated rows are documents like others and get their own
slots; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinrank.functions.ranking import global_row_number
from kinrank.llm.common import row_key, text_of
from kinrank.plans.context import discard, materialize

SHARDS = 24
FINE = 128
OVERHEAD = 8


def schedule(sizes: list[int], shards: int) -> list[int]:
    """The shard of every item: largest first, each to the least loaded shard
    (the lowest number among equals)."""
    loads = [(0, shard) for shard in range(shards)]
    placed = [0] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, shard = loads[0]
        placed[item] = shard
        heapq.heapreplace(loads, (load + sizes[item], shard))
    return placed


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.
    Runs jobs when called."""
    spark, text = docs.sparkSession, text_of()
    rows = materialize(docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), *row_key(text),
    ))
    groups = materialize(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    items = shards * FINE
    large = groups.filter(F.col("bytes") * items >= total)
    bundle = F.pmod(F.col("k1"), F.lit(items)).cast("int")
    small = groups.filter(F.col("bytes") * items < total).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    alone = [(r.k1, r.k2, None, r.bytes) for r in large.orderBy("k1", "k2").collect()]
    bundled = [(None, None, r.bundle, r.bytes) for r in small.orderBy("bundle").collect()]
    placed = schedule([x[3] for x in alone + bundled], shards)
    plan = [(*item[:3], shard) for item, shard in zip(alone + bundled, placed)]
    table = spark.createDataFrame(plan, "k1 long, k2 long, bundle int, shard int")
    of_group = F.broadcast(table.filter("bundle is null").select("k1", "k2", F.col("shard").alias("own")))
    of_bundle = F.broadcast(table.filter("bundle is not null").select("bundle", F.col("shard").alias("shared")))
    placed_rows = (
        rows.join(of_group, ["k1", "k2"], "left")
        .join(of_bundle, bundle == of_bundle["bundle"], "left")
        .select("doc_id", "size", "text_crc32", "k1", "k2", F.coalesce("own", "shared").alias("shard"))
    )
    numbered = global_row_number(placed_rows, ["shard", "k1", "k2", "doc_id"], name="_rn")
    first = numbered.groupBy("shard").agg(F.min("_rn").alias("_first"))
    discard(groups)
    return numbered.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_rn") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
