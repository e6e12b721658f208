import random

import pytest
from pyspark.sql import functions as F

from kinrank.functions import metrics
from kinrank.functions.ranking import global_row_number, group_row_number


def test_global_row_number_matches_sort(spark):
    rows = [(i, random.Random(i).randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(7)
    got = global_row_number(df, [F.col("v").desc(), F.col("k")], num_partitions=5)
    expect = sorted(rows, key=lambda t: (-t[1], t[0]))
    assert [(r.k, r.rn) for r in got.orderBy("rn").collect()] == [(k, i + 1) for i, (k, _) in enumerate(expect)]


def test_group_row_number_with_hot_group(spark):
    # one group holds most rows: it is split over several range partitions
    rows = [(0 if i % 4 else i, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g bigint, v bigint")
    got = group_row_number(df, ["g"], [F.col("v").desc()], num_partitions=6)
    by_g = {}
    for r in got.collect():
        by_g.setdefault(r.g, []).append((r["rank"], r.v))
    for g, lst in by_g.items():
        lst.sort()
        assert [x for x, _ in lst] == list(range(1, len(lst) + 1))
        assert [v for _, v in lst] == sorted((v for _, v in lst), reverse=True)


def test_quantile_bucket_sizes(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(12)], "key bigint, value double")
    rows = metrics.quantile_buckets(df, "value", "key", 10)
    assert rows.count() == 10
    numbered = global_row_number(df, [F.col("value"), F.col("key")], name="_rn")
    n = 12
    sizes = {}
    for r in numbered.collect():
        b = max(0, ((r._rn - 1) * 10 + (n - 2)) // (n - 1) - 1)
        sizes[b] = sizes.get(b, 0) + 1
    assert [sizes[b] for b in range(10)] == [2, 1, 1, 1, 1, 1, 1, 1, 1, 2]


def test_single_value_bucket(spark):
    df = spark.createDataFrame([(1, 2.0)], "key bigint, value double")
    r = metrics.quantile_buckets(df, "value", "key", 10).collect()
    assert [(x.bucket, x.mean_value) for x in r] == [(0, 2.0)]


def test_coverage_can_exceed_one(spark):
    recs = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "user_id bigint, item_id bigint")
    frame = spark.createDataFrame([(1, 1), (2, 1)], "user_id bigint, item_id bigint")
    assert metrics.coverage(recs, frame).first()["coverage"] == pytest.approx(3.0)


def test_list_precision_counts_missing_users(spark):
    truth = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "user_id bigint, item_id bigint")
    pred = spark.createDataFrame([(1, 2), (1, 3)], "user_id bigint, item_id bigint")
    got = {r.user_id: r.precision for r in metrics.list_precision(truth, pred, 2).collect()}
    assert got == {1: 0.5, 2: 0.0}


def test_a_small_table_is_numbered_without_empty_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
        numbered = global_row_number(df, [F.col("v")])
        files = len(numbered.inputFiles())
        got = {r.v: r.rn for r in numbered.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {v: v + 1 for v in range(1000)}
    assert files < 64
