"""The n-th row of an order, found without sorting the table.

``nth_key`` narrows the key of the n-th row column by column: an equal-width
histogram of the values still possible (a partial aggregate of at most
``BUCKETS`` rows) says which bucket holds the row, the bucket's own smallest and
largest value are the next range, and once they are one value the next column
follows among the rows that have it.  Each pass filters on the range found so
far, which reaches the scan.  As soon as few rows are left, they are ordered.
Nothing is written, and only histograms reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType

BUCKETS = 1024
#: Rows that are ordered instead of narrowed further.
FEW = 100_000


class Nth(NamedTuple):
    """The key of the n-th row, and how many of the rows with that key are among the first n."""

    key: tuple
    among: int


def _number(column: str, kind: DataType) -> Column:
    """The column as a number in its own order."""
    if isinstance(kind, DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, TimestampNTZType):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if isinstance(kind, NumericType):
        return F.col(column).cast("double")
    raise TypeError(f"no order statistics on {column} of type {kind.simpleString()}")


def _after(position: int, histogram: list) -> tuple[int, int]:
    """(index of the row of the histogram that holds ``position``, position within it)."""
    for i, row in enumerate(histogram):
        if position <= row.n:
            return i, position
        position -= row.n
    raise ValueError("position beyond the rows")


def nth_key(df: DataFrame, order: Sequence[str], n: int) -> Nth | None:
    """The key (values of ``order``, nulls first) of the n-th row; None if there are
    fewer than n rows.  Columns of ``order`` are numbers, dates or timestamps.

    Values are told apart as doubles while narrowing; where several values fall on
    one double they are ordered like the few rows at the end.
    """
    rest, key, position = df.select(*order), [], n
    left = rest.count()
    if n > left or n < 1:
        return None
    for depth, column in enumerate(order):
        number, low, high, value = _number(column, df.schema[column].dataType), None, None, F.col(column)
        while left > FEW:
            bucket = F.lit(0) if low is None or high == low else F.least(
                F.lit(BUCKETS - 1), F.floor((number - low) / ((high - low) / BUCKETS)))
            histogram = sorted(
                rest.groupBy(F.when(value.isNotNull(), bucket).alias("bucket")).agg(
                    F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"),
                    F.min(number).alias("low"), F.max(number).alias("high")).collect(),
                key=lambda row: (row.bucket is not None, row.bucket))
            at, position = _after(position, histogram)
            found = histogram[at]
            left = found.n
            if found.bucket is None:
                rest = rest.filter(value.isNull())
                key.append(None)
                break
            rest = rest.filter(value.between(F.lit(found.least), F.lit(found.most)))
            if found.least == found.most:
                key.append(found.least)
                break
            if (found.low, found.high) == (low, high) and len(histogram) == 1:
                raise ValueError(f"{column}: more than {FEW} rows of different values on one double")
            low, high = found.low, found.high
        else:
            # Few rows share the key so far: order them by what is left of it.
            rows = rest.orderBy(*order[depth:]).offset(position - 1).limit(1).select(*order[depth:])
            key += list(rows.first())
            break
    smaller = df.filter(before(order, key)).count()
    return Nth(tuple(key), n - smaller)


def equal_to(order: Sequence[str], key: Sequence) -> Column:
    """True for the rows with this key."""
    same = F.lit(True)
    for column, value in zip(order, key):
        same = same & (F.col(column).isNull() if value is None else F.coalesce(F.col(column) == F.lit(value), F.lit(False)))
    return same


def before(order: Sequence[str], key: Sequence) -> Column:
    """True for the rows that come before the key, nulls first."""
    result = F.lit(False)
    for i, (column, value) in enumerate(zip(order, key)):
        smaller = F.lit(False) if value is None else F.col(column).isNull() | (F.col(column) < F.lit(value))
        result = result | (equal_to(order[:i], key[:i]) & F.coalesce(smaller, F.lit(False)))
    return result


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` as filters on the n-th row's key: no sort, no
    written copy.  Rows with equal keys are told apart by their other columns'
    content only; of rows equal throughout, as many as belong to the first n."""
    found = nth_key(df, order, n)
    if found is None:
        return df if n > 0 else df.limit(0)
    ties = df.filter(equal_to(order, found.key))
    count = ties.count()
    bound = F.col(order[0]).isNull() | (F.col(order[0]) <= F.lit(found.key[0])) if found.key[0] is not None else F.col(order[0]).isNull()
    if count == found.among:
        return df.filter(bound & (before(order, found.key) | equal_to(order, found.key)))
    others = [c for c in df.columns if c not in order]
    some = ties.orderBy(*others).limit(found.among) if others else ties.limit(found.among)
    return df.filter(bound & before(order, found.key)).unionByName(some)
