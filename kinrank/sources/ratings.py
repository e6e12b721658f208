"""Ratings and items sources (IO1, IO2).

Two ways in:

* MovieLens-style CSV files (``userId,movieId,rating,timestamp`` and
  ``movieId,title,genres``) read with a fixed schema -- schema inference
  would cost an extra pass over the data and may change types.
* A stand-in built from the TPC-H-like driver tables: a customer rates a
  part it bought; one rating per (customer, part), taken from the latest
  line item.  Rating values are multiples of 0.5 in [0.5, 5.0].
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinrank import ITEM, RATING, TS, USER

RATINGS_SCHEMA = T.StructType(
    [
        T.StructField(USER, T.LongType(), False),
        T.StructField(ITEM, T.LongType(), False),
        T.StructField(RATING, T.DoubleType(), True),
        T.StructField(TS, T.TimestampType(), True),
    ]
)

ITEMS_SCHEMA = T.StructType(
    [
        T.StructField(ITEM, T.LongType(), False),
        T.StructField("title", T.StringType(), True),
        T.StructField("genres", T.StringType(), True),
    ]
)

# Fixed values of the MovieLens CSV layout.
_CSV_RATINGS = "userId BIGINT, movieId BIGINT, rating DOUBLE, timestamp LONG"
_CSV_MOVIES = "movieId BIGINT, title STRING, genres STRING"
NO_GENRE = "(no genres listed)"


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """IO1: ratings CSV with a header, fixed schema, epoch-second timestamps.
    A malformed row fails the read (FAILFAST) rather than turning into nulls."""
    raw = _csv(spark, _CSV_RATINGS, path)
    return raw.select(
        F.col("userId").alias(USER), F.col("movieId").alias(ITEM), F.col("rating").alias(RATING),
        F.timestamp_seconds("timestamp").alias(TS),
    )


def read_items_csv(spark: SparkSession, path: str) -> DataFrame:
    """IO2: movies CSV with a header and a fixed schema; malformed rows fail the read."""
    return _csv(spark, _CSV_MOVIES, path).select(F.col("movieId").alias(ITEM), "title", "genres")


def _csv(spark: SparkSession, schema: str, path: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standin_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO1 on the driver tables: ``(user_id, item_id, rating, ts)``.

    The latest line item per (customer, part) wins; ties on the ship date
    fall to the larger order key, line number, supplier, price, quantity.
    That "latest" row is found with ``max(struct(...))`` -- a partial
    (map-side) aggregate, so a customer or part holding a large share of
    the line items is pre-reduced before the shuffle instead of being sorted
    in one window task.
    """
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_shipdate",
    )
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_size")

    latest = (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .groupBy(F.col("o_custkey").alias(USER), F.col("l_partkey").alias(ITEM))
        .agg(
            F.max(
                F.struct(
                    "l_shipdate", "l_orderkey", "l_linenumber",
                    "l_suppkey", "l_extendedprice", "l_quantity",
                )
            ).alias("m")
        )
    )
    taste = F.when(F.col(USER) % 4 == F.col(ITEM) % 4, 3).otherwise(0)
    score = F.least(
        F.lit(10),
        1 + F.col("m.l_quantity").cast("bigint") % 4 + F.col("p_size") % 6 + taste,
    )
    return latest.join(part, latest[ITEM] == part.p_partkey).select(
        F.col(USER).cast("bigint").alias(USER),
        F.col(ITEM).cast("bigint").alias(ITEM),
        (score.cast("double") / 2).alias(RATING),
        F.col("m.l_shipdate").alias(TS),
    )


def standin_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO2 on the driver tables: ``(item_id, title, genres)``.

    Title carries a year in parentheses; PROMO parts play the role of
    movies with no genre.
    """
    part = _table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("bigint").alias(ITEM),
        F.concat(
            F.col("p_name"), F.lit(" ("), (1950 + F.col("p_size")).cast("string"), F.lit(")")
        ).alias("title"),
        F.when(F.col("p_type") == "PROMO", F.lit(NO_GENRE))
        .otherwise(F.col("p_type"))
        .alias("genres"),
    )


def standin_rating_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a rating event, duplicates per (customer, part) kept.

    Same rating rule as ``standin_ratings``; input for the duplicate-
    averaging step of the neighbourhood model.
    """
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    j = li.join(orders, li.l_orderkey == orders.o_orderkey).join(part, li.l_partkey == part.p_partkey)
    user, item = F.col("o_custkey"), F.col("l_partkey")
    taste = F.when(user % 4 == item % 4, 3).otherwise(0)
    score = F.least(F.lit(10), 1 + F.col("l_quantity").cast("bigint") % 4 + F.col("p_size") % 6 + taste)
    return j.select(
        user.cast("bigint").alias(USER),
        item.cast("bigint").alias(ITEM),
        (score.cast("double") / 2).alias(RATING),
        F.col("l_shipdate").alias(TS),
    )


def standin_line_ratings(spark: SparkSession, sf_dir: str, user: str = "l_orderkey", item: str = "l_partkey") -> DataFrame:
    """Every line item as a rating with orders and parts in the two roles:
    a long-tailed table, with users (or items) that occur once."""
    li = _table(spark, sf_dir, "lineitem")
    return li.select(
        F.col(user).cast("bigint").alias(USER), F.col(item).cast("bigint").alias(ITEM),
        ((1 + F.col("l_quantity").cast("bigint") % 10).cast("double") / 2).alias(RATING),
        F.col("l_shipdate").alias(TS),
    )
