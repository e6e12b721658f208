"""Joins whose hot keys are split over tasks by measured output, not by luck.

Catalyst sizes and coalesces join tasks by input bytes.  A join that
multiplies rows (a user's neighbours times each neighbour's ratings) can be
tiny at its inputs and huge at its output, and one hub key can own most of
it.  ``measure`` adds up the output rows per key; ``split_join`` deals keys
above ``ROWS_PER_TASK`` out over parts (one side by a hash of its rows, the
other copied to each part) and spreads both sides over as many partitions as
the total output asks for.  There is at most one hot key per task of output,
and the table of them is broadcast only up to ``BROADCAST_KEYS``.  Outputs of less
than ``SMALL_OUTPUT`` rows are left to Catalyst.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinrank.plans.context import materialize, partition_count

ROWS_PER_TASK = 2_000_000
SMALL_OUTPUT = 500_000
#: Output rows of a task while there are fewer tasks than shuffle partitions.
TASK_OUTPUT = 500_000
BROADCAST_KEYS = 500_000


class Loads(NamedTuple):
    """Output rows of a join, and its hot keys with their parts per side."""

    total: int
    hot: DataFrame | None  # (key, _left_parts, _right_parts)
    few: bool  # hot keys may be broadcast

    @property
    def partitions(self) -> int:
        return -(-self.total // ROWS_PER_TASK)


NONE = Loads(0, None, True)


def loads_of(counts: DataFrame, key: str) -> Loads:
    """The loads from ``counts`` (key, _l, _r): rows of a key on either side.

    A hot key's parts come from the left side as far as it has rows, the rest
    from the right, so a key with one left row and very many right rows is
    split as well.  One job; a second one only where there are hot keys.
    """
    rows = counts.select(key, "_l", "_r", (F.col("_l") * F.col("_r")).alias("_rows"))
    is_hot = F.col("_rows") > ROWS_PER_TASK
    seen = rows.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("total"), F.count_if(is_hot).alias("hot")).first()
    if not seen.hot:
        return Loads(int(seen.total), None, True)
    parts = F.ceil(F.col("_rows") / ROWS_PER_TASK)
    left_parts = F.least(parts, F.col("_l"))
    hot = materialize(rows.filter(is_hot).select(
        key, left_parts.cast("int").alias("_left_parts"), F.ceil(parts / left_parts).cast("int").alias("_right_parts")))
    return Loads(int(seen.total), hot, seen.hot <= BROADCAST_KEYS)


def tasks_for(spark: SparkSession, total: int) -> int:
    """Partitions for ``total`` rows that come out of few: at most ``ROWS_PER_TASK`` each."""
    return max(partition_count(spark, total, TASK_OUTPUT), -(-total // ROWS_PER_TASK))


def measure(left: DataFrame, right: DataFrame, key: str) -> Loads:
    """The loads of ``left`` joined to ``right`` on ``key`` (partial aggregates)."""
    return loads_of(
        left.groupBy(key).agg(F.count(F.lit(1)).alias("_l")).join(
            right.groupBy(key).agg(F.count(F.lit(1)).alias("_r")), key), key)


def split_join(left: DataFrame, right: DataFrame, on: Sequence[str], by: str, loads: Loads) -> DataFrame:
    """Inner join on ``on``, which holds ``by``; keys of ``by`` that are hot in
    ``loads`` are spread over their parts."""
    n = tasks_for(left.sparkSession, loads.total)
    if loads.hot is None:
        if loads.total <= SMALL_OUTPUT:
            return left.join(right, list(on))
        return left.repartition(n, *on).join(right.repartition(n, *on), list(on))
    hot = F.broadcast(loads.hot) if loads.few else loads.hot

    def dealt(side: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        mine = F.pmod(F.xxhash64(*side.columns), F.coalesce(F.col(own), F.lit(1))).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        return side.join(hot, by, "left").select(
            *side.columns, mine.alias(names[0]), copies.alias(names[1])).repartition(n, *on, "_p", "_q")

    a = dealt(left, "_left_parts", "_right_parts", ("_p", "_q"))
    b = dealt(right, "_right_parts", "_left_parts", ("_q", "_p"))
    return a.join(b, [*on, "_p", "_q"]).drop("_p", "_q")
