"""Property tests: distributed numbering and buckets against plain Python."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinrank.functions import metrics
from kinrank.functions.ranking import global_row_number, group_row_number

rows_st = st.lists(st.tuples(st.integers(0, 5), st.integers(-3, 3)), min_size=1, max_size=60)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(rows=rows_st, parts=st.integers(1, 6))
def test_global_row_number_is_a_sort(spark, rows, parts):
    data = [(i, g, v) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k bigint, g bigint, v bigint").repartition(parts)
    got = global_row_number(df, [F.col("v").desc(), F.col("k")], num_partitions=parts)
    want = [k for k, _, _ in sorted(data, key=lambda t: (-t[2], t[0]))]
    assert [r.k for r in got.orderBy("rn").collect()] == want
    assert sorted(r.rn for r in got.collect()) == list(range(1, len(data) + 1))


@SETTINGS
@given(rows=rows_st, parts=st.integers(1, 6))
def test_group_row_number_is_a_per_group_sort(spark, rows, parts):
    data = [(i, g, v) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k bigint, g bigint, v bigint")
    got = {r.k: r["rank"] for r in group_row_number(df, ["g"], [F.col("v"), F.col("k")],
                                                    num_partitions=parts).collect()}
    for g in {t[1] for t in data}:
        members = sorted((t for t in data if t[1] == g), key=lambda t: (t[2], t[0]))
        assert [got[t[0]] for t in members] == list(range(1, len(members) + 1))


@SETTINGS
@given(values=st.lists(st.integers(0, 9), min_size=1, max_size=40), q=st.integers(1, 12))
def test_quantile_bucket_means(spark, values, q):
    data = [(i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "key bigint, value double")
    got = {r.bucket: r.mean_value for r in metrics.quantile_buckets(df, "value", "key", q).collect()}
    n = len(data)
    ranked = sorted(data, key=lambda t: (t[1], t[0]))
    sums: dict[int, list[float]] = {}
    for rn, (_, v) in enumerate(ranked, start=1):
        b = 0 if n == 1 else max(0, ((rn - 1) * q + (n - 2)) // (n - 1) - 1)
        sums.setdefault(b, []).append(v)
    want = {b: sum(vs) / len(vs) for b, vs in sums.items()}
    assert got.keys() == want.keys()
    for b in want:
        assert abs(got[b] - want[b]) < 1e-9
