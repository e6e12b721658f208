"""Connected components of a link table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinrank.plans.context import discard, materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node in ``links``; root: the smallest node reachable.

    Alternates "large star" (every larger neighbour links to the smallest
    neighbour) and "small star" (every node links its smaller neighbours to
    the smallest) until nothing changes: O(log^2) rounds.  Smallest
    neighbours are partial aggregates, so a node with very many links sends
    one row per task; joins back to the links are on one unique side, which
    lets AQE split a hot node.  Each round is a written table; the one before
    is removed.  Runs jobs when called.
    """
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = materialize(links.select(high, low).filter("u <> v").distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(smallest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = materialize(small)
        now = _state(after)
        discard(edges)
        edges = after
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
