"""Evaluation metrics (MT1-MT9) as DataFrame aggregates.

Per-key results keep their key.  Null predictions are left out of every
metric (sum and count alike).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinrank import ITEM, RATING, USER
from kinrank.functions.ranking import global_row_number


def _sq_err(label: str, pred: str):
    return F.pow(F.col(label) - F.col(pred), 2)


def rmse(df: DataFrame, label: str = RATING, pred: str = "prediction") -> DataFrame:
    """MT1: one row ``rmse`` over the rows with a prediction."""
    return df.filter(F.col(pred).isNotNull()).agg(
        F.sqrt(F.avg(_sq_err(label, pred))).alias("rmse")
    )


def rmse_by(df: DataFrame, key, label: str = RATING, pred: str = "prediction") -> DataFrame:
    """MT2: ``(key, rmse)``; one partial aggregate instead of sum + count + join.

    ``key`` is a column name or a list of them.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return (
        df.filter(F.col(pred).isNotNull())
        .groupBy(*keys)
        .agg(F.sqrt(F.avg(_sq_err(label, pred))).alias("rmse"))
    )


def list_precision(
    truth: DataFrame, predicted: DataFrame, k: int, users: DataFrame | None = None,
    user: str = USER, item: str = ITEM,
) -> DataFrame:
    """MT3: per user, distinct common items of two (already cut) lists over k.

    ``truth`` and ``predicted`` are long-form ``(user, item)`` rows.  Users
    in ``users`` (default: the truth users) with no common item score 0.
    """
    users = (users if users is not None else truth).select(user).distinct()
    hits = (
        truth.select(user, item).distinct()
        .join(predicted.select(user, item).distinct(), [user, item])
        .groupBy(user)
        .agg(F.count(F.lit(1)).alias("_hits"))
    )
    return users.join(hits, user, "left").select(
        user, (F.coalesce(F.col("_hits"), F.lit(0)) / F.lit(float(k))).alias("precision")
    )


def mean_of(df: DataFrame, col: str, alias: str | None = None) -> DataFrame:
    """MT5: one-row mean."""
    return df.agg(F.avg(col).alias(alias or col))


def coverage(recs: DataFrame, frame: DataFrame, item: str = ITEM, rec_item: str = ITEM) -> DataFrame:
    """MT4: distinct recommended items over distinct items of the frame.

    Both counts are global aggregates of deduplicated keys; the result is
    one row ``coverage`` (it may exceed 1 when recommendations come from a
    wider catalogue than the frame).
    """
    tagged = (
        recs.select(F.col(rec_item).alias("_i"), F.lit(1).alias("_rec")).distinct()
        .unionByName(frame.select(F.col(item).alias("_i"), F.lit(0).alias("_rec")).distinct())
    )
    return tagged.agg(
        (F.sum(F.col("_rec")).cast("double") / F.sum(1 - F.col("_rec"))).alias("coverage")
    )


def bitmap_coverage(recs: DataFrame, frame: DataFrame, number: str, item: str = ITEM) -> DataFrame:
    """MT4 for recommendations that carry their items' dense numbers (1, 2, ...): the
    distinct items are bits in bitmaps of 32,768 items each, a partial aggregate
    that sends one bitmap per task and range of items, however long the lists are."""
    bits = recs.groupBy(F.bitmap_bucket_number(number).alias("_range")).agg(
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(number))).alias("_n"))
    seen = frame.select(item).distinct().agg(F.count(F.lit(1)).alias("_all"))
    return bits.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n")).select(
        (F.col("_n").cast("double") / seen.scalar()).alias("coverage"))


def cut_ranking(ranked: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """MT6: first ``k`` of a long-form ranking."""
    return ranked.filter(F.col(rank) <= k)


def ranked_coverage(
    frame: DataFrame, ranked: DataFrame, k: int, user: str = USER, item: str = ITEM
) -> DataFrame:
    """MT7: frame rows joined to their user's cut ranking, then MT4.

    Only users present on both sides count (an inner join), for the
    numerator and the denominator alike.
    """
    cut = cut_ranking(ranked, k).select(user, item)
    both = frame.select(user).distinct().join(cut.select(user).distinct(), user)
    recs = cut.join(both, user, "left_semi")
    seen = frame.join(both, user, "left_semi")
    return coverage(recs, seen, item=item, rec_item=item)


def quantile_buckets(
    metric: DataFrame, value: str, key: str, q: int = 10, bucket: str = "bucket"
) -> DataFrame:
    """MT8: equal-frequency buckets of a metric, mean per bucket.

    Rows are numbered 1..n by (value, key) -- ties fall to the key -- and
    row ``rn`` goes to ``max(0, ceil((rn-1)*q/(n-1)) - 1)`` (0 when n = 1):
    the bucketing of ranks by equal-width edges over [1, n].  This is not
    ``ntile``.  Null values are left out.  The numbering is distributed
    (range partitions + offsets), not a single-partition window.
    """
    rows = metric.select(key, value).filter(F.col(value).isNotNull())
    numbered = global_row_number(rows, [F.col(value), F.col(key)], name="_rn")
    total = numbered.agg(F.count(F.lit(1))).scalar()  # scalar subquery
    b = F.when(F.col("_n") <= 1, F.lit(0)).otherwise(
        F.greatest(
            F.lit(0),
            F.expr(f"((_rn - 1) * {int(q)} + (_n - 2)) div (_n - 1)") - 1,
        )
    )
    return (
        numbered.withColumn("_n", total)
        .withColumn(bucket, b.cast("bigint"))
        .groupBy(bucket)
        .agg(F.avg(value).alias("mean_value"))
    )


def quantile_compare(
    runs: Mapping[str, DataFrame], value: str, key: str, q: int = 10
) -> DataFrame:
    """MT9: bucket means of several runs side by side, one column per run."""
    labels: Sequence[str] = list(runs)
    parts = [
        quantile_buckets(df, value, key, q).withColumn("run", F.lit(label))
        for label, df in runs.items()
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return stacked.groupBy("bucket").pivot("run", labels).agg(F.first("mean_value"))
