"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal places used when ordering by a computed double: sums of doubles
# differ in the last bits between partitionings, so an unrounded sort can
# swap near-equal values from run to run.
TIE_DIGITS = 9


def split_hash(user: str, item: str, seed: int) -> Column:
    """First 8 hex digits of md5('user:item:seed') as an integer.

    A pure function of the row, so the split is the same under any
    partitioning, on recomputation after executor loss, and in SQL engines
    with md5 (``randomSplit`` depends on partition layout and row order).
    """
    key = F.concat_ws(":", F.col(user).cast("string"), F.col(item).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def in_train(user: str, item: str, seed: int = 12345, train_tenths: int = 8) -> Column:
    """True for the training share (``train_tenths`` out of 10)."""
    return split_hash(user, item, seed) % 10 < train_tenths


def tie_key(c: Column | str) -> Column:
    """Rounded copy of a double for use in an ORDER BY."""
    return F.round(F.col(c) if isinstance(c, str) else c, TIE_DIGITS)
