"""Ranking helpers that stay distributed.

* ``top_k_per_group``: ``row_number`` over a per-group window, filtered to
  ``<= k``.  Spark (3.5+) plans this with a partial ``WindowGroupLimit``
  before the shuffle, so every map task forwards at most ``k`` rows per
  group: a hot group costs ``k`` rows per task, not its full size.
* ``global_row_number``: an exact 1..N row number over a total order
  without a single-partition window.  Rows are range-partitioned on the
  order, sorted inside each partition and tagged with
  ``monotonically_increasing_id`` (partition index in the high bits, row
  position in the low 33 bits); per-partition counts (one row per
  partition, so the broadcast is bounded by the partition count) give
  each partition its offset.
* ``group_row_number``: the same trick with the group keys leading the
  order, minus the first number of the group.  A group larger than a
  partition is spread over several range partitions instead of being
  sorted by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinrank.plans.context import materialize

_LOW_BITS = (1 << 33) - 1


def _cols(cols: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def top_k_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    k: int | None,
    name: str = "rank",
) -> DataFrame:
    """Number rows per group by ``order``; keep ranks ``<= k`` (all if None)."""
    w = Window.partitionBy(*group).orderBy(*_cols(order))
    ranked = df.withColumn(name, F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col(name) <= k)


def global_row_number(
    df: DataFrame,
    order: Sequence[Column | str],
    name: str = "rn",
    num_partitions: int | None = None,
) -> DataFrame:
    """Exact row number 1..N over ``order`` (which must be a total order)."""
    order_cols = _cols(order)
    # Without a number adaptive execution merges neighbouring ranges of a small table; the order stays.
    ranged = [num_partitions, *order_cols] if num_partitions else order_cols
    tagged = materialize(
        df.repartitionByRange(*ranged)
        .sortWithinPartitions(*order_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    pid = F.shiftright(F.col("_mid"), 33)
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    return (
        tagged.join(F.broadcast(offsets), pid == offsets["_pid"])
        .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(_LOW_BITS) + 1)
        .drop("_mid", "_pid", "_off")
    )


def group_row_number(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    name: str = "rank",
    num_partitions: int | None = None,
) -> DataFrame:
    """Row number per group with no per-group task: skew-safe full rankings."""
    numbered = global_row_number(
        df, [*_cols(group), *_cols(order)], name="_grn", num_partitions=num_partitions
    )
    first = numbered.groupBy(*group).agg(F.min("_grn").alias("_first"))
    return (
        numbered.join(first, list(group))
        .withColumn(name, (F.col("_grn") - F.col("_first") + 1).cast("int"))
        .drop("_grn", "_first")
    )
