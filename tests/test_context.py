import os

import pytest

from kinrank.functions.ranking import global_row_number
from kinrank.plans import context
from pyspark.sql import functions as F


def test_numbering_raises_without_a_shared_folder(spark, monkeypatch):
    def none(_):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")

    monkeypatch.setattr(context, "shared_dir", none)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        global_row_number(spark.range(10), ["id"])


def test_numbers_are_one_to_n_with_a_payload(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), F.repeat(F.lit("x"), 50).alias("pay"))
    got = global_row_number(rows, ["k"], num_partitions=7)
    assert got.agg(F.countDistinct("rn"), F.min("rn"), F.max("rn")).first()[:] == (20_000, 1, 20_000)


def test_tables_can_be_dropped(spark):
    before = context.tables(spark)
    one, two = context.materialize(spark.range(3)), context.materialize(spark.range(4))
    made = context.tables(spark) - before
    assert len(made) == 2 and one.count() == 3
    context.discard(one)
    assert len(context.tables(spark) - before) == 1
    assert context.drop_tables(spark, made) == 1
    assert context.tables(spark) == before
    assert not any(os.path.exists(path.removeprefix("file:")) for path in made) and two is not None


def test_few_rows_take_few_partitions_and_many_all(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: "200")
    few = 2 * spark.sparkContext.defaultParallelism
    assert context.partition_count(spark) == 200
    assert context.partition_count(spark, 0) == few
    assert context.partition_count(spark, 3_000_000) == 30
    assert context.partition_count(spark, 10**9) == 200
