"""The first n rows by order statistics against a sort."""

import datetime as dt
import random

import pytest

from kinrank.functions import selection
from kinrank.operators import prepare

SCHEMA = "ts timestamp, user_id bigint, item_id bigint, rating double"


def rows_of(seed, n=400, hot=False):
    rnd = random.Random(seed)
    start = dt.datetime(2020, 1, 1)
    out = []
    for _ in range(n):
        when = start if hot and rnd.random() < 0.7 else start + dt.timedelta(seconds=rnd.randrange(10**7))
        out.append((when if rnd.random() > 0.05 else None, rnd.randrange(9), rnd.randrange(-40, 40), rnd.choice([1.0, 2.0])))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is not None, v) for v in r])


@pytest.mark.parametrize("few", [1, 7, 100_000])
@pytest.mark.parametrize("hot", [False, True])
def test_first_rows_equal_a_sort(spark, monkeypatch, few, hot):
    """Nulls first, a hot leading value, repeated rows, ranges of a few buckets."""
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BUCKETS", 8)
    rows = rows_of(3, hot=hot)
    rows += [rows[0]] * 5
    df = spark.createDataFrame(rows, SCHEMA)
    order = ["ts", "user_id", "item_id"]
    for n in (1, 19, 20, 150, 300, 404, 405, 500):
        got = [tuple(r) for r in selection.first_rows(df, order, n).collect()]
        assert ordered(got) == ordered(rows)[:n]


def test_first_rows_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert selection.first_rows(df, ["ts"], 5).collect() == []
    full = spark.createDataFrame(rows_of(1, 10), SCHEMA)
    assert selection.first_rows(full, ["ts"], 0).collect() == []
    assert selection.nth_key(full, ["ts"], 11) is None


def test_the_cap_sorts_and_writes_nothing(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(selection, "FEW", 10)
    path = str(tmp_path / "ratings")
    spark.createDataFrame([(None, u, i, 1.0) for u in range(30) for i in range(20)], SCHEMA).write.parquet(path)
    capped = prepare.cap_sample(spark.read.parquet(path), 333, ("user_id", "item_id"))
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "LessThanOrEqual(user_id,16)" in plan
    assert sorted((r.user_id, r.item_id) for r in capped.collect())[-1] == (16, 12) and capped.count() == 333


def test_unordered_types_are_refused(spark):
    df = spark.createDataFrame([("a",)] * 3, "name string")
    with pytest.raises(TypeError):
        selection.nth_key(df, ["name"], 2)
