"""Popularity / mean-rating baseline (BL1-BL6).

Model = one row per item with its mean rating and rating count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinrank import ITEM, RATING, USER
from kinrank.functions import metrics
from kinrank.functions.ranking import group_row_number, top_k_per_group


def truth_order():
    return (F.col(RATING).desc(), F.col(ITEM).desc())


def item_stats(train: DataFrame) -> DataFrame:
    """BL1: ``(item_id, avg_rating, review_count)`` -- a partial aggregate."""
    return train.groupBy(ITEM).agg(
        F.avg(RATING).alias("avg_rating"), F.count(USER).alias("review_count")
    )


def predict(test: DataFrame, stats: DataFrame) -> DataFrame:
    """BL2: item mean as the prediction; unseen items keep a null."""
    return test.join(stats, ITEM, "left").select(ITEM, USER, RATING, "avg_rating", "review_count")


def rmse(predictions: DataFrame) -> DataFrame:
    """BL3."""
    return metrics.rmse(predictions, RATING, "avg_rating")


def popular_top_k(stats: DataFrame, k: int, min_avg: float = 4.0) -> DataFrame:
    """BL4: items with mean >= ``min_avg``, most rated first (ties: id desc)."""
    top = stats.filter(F.col("avg_rating") >= min_avg).orderBy(
        F.col("review_count").desc(), F.col(ITEM).desc()
    ).limit(k)
    # k rows: a global window over them is one tiny task.
    w = Window.orderBy(F.col("review_count").desc(), F.col(ITEM).desc())
    return top.withColumn("rank", F.row_number().over(w))


def user_truth_ranking(frame: DataFrame, k: int | None = None) -> DataFrame:
    """BL5: each user's items by rating desc, then id desc.

    ``k`` given: the first k (partial top-k before the shuffle).  Otherwise
    the full ranking, numbered without a per-user task.
    """
    rows = frame.select(USER, ITEM, RATING)
    if k is not None:
        return top_k_per_group(rows, [USER], truth_order(), k)
    return group_row_number(rows, [USER], truth_order())


def precision_by_user(frame: DataFrame, stats: DataFrame, k: int, min_avg: float = 4.0) -> DataFrame:
    """BL6 per user: |first k of the user's list  ∩  first n_u+1 popular| / k.

    The popular list has at most k rows, so it is broadcast with a proven
    bound.  An empty popular list scores 0 for everyone.
    """
    popular = F.broadcast(popular_top_k(stats, k, min_avg).select(ITEM, F.col("rank").alias("_prank")))
    n_user = frame.groupBy(USER).agg(F.count(F.lit(1)).alias("_n"))
    truth = user_truth_ranking(frame, k).select(USER, ITEM)
    hits = (
        truth.join(popular, ITEM)
        .join(n_user, USER)
        .filter(F.col("_prank") <= F.col("_n") + 1)
        .groupBy(USER)
        .agg(F.count(F.lit(1)).alias("_hits"))
    )
    return n_user.join(hits, USER, "left").select(
        USER, (F.coalesce(F.col("_hits"), F.lit(0)) / F.lit(float(k))).alias("precision")
    )


def precision_at_k(frame: DataFrame, stats: DataFrame, k: int, min_avg: float = 4.0) -> DataFrame:
    """BL6: mean over users, one row ``precision``."""
    return metrics.mean_of(precision_by_user(frame, stats, k, min_avg), "precision")
