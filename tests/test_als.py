import pytest
from pyspark.sql import functions as F

from kinrank.operators import als


@pytest.fixture(scope="module")
def planted(spark):
    # rank-1 planted matrix: rating = u_f * i_f, all users x items
    rows = [(u, i, float(1 + ((u % 3) + 1) * ((i % 2) + 1) / 2)) for u in range(30) for i in range(20)]
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double")


def test_als_beats_global_mean_and_is_repeatable(planted):
    fit = als.fit(planted, rank=3, max_iter=10, reg_param=0.01)
    scored = als.predict(fit, planted)
    assert scored.filter(F.col("predicted_rating").isNull()).count() == 0
    err = als.rmse(scored).first()["rmse"]
    mean = planted.agg(F.avg("rating")).first()[0]
    base = planted.agg(F.sqrt(F.avg((F.col("rating") - mean) ** 2))).first()[0]
    assert err < base / 2
    again = als.rmse(als.predict(als.fit(planted, rank=3, max_iter=10, reg_param=0.01), planted))
    assert again.first()["rmse"] == pytest.approx(err, rel=1e-9)


def test_large_ids_are_indexed(spark):
    big = 10**12
    rows = [(big + u, big + i, float((u + i) % 5 + 1)) for u in range(10) for i in range(8)]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double")
    fit = als.fit(df, rank=2, max_iter=3)
    assert fit.codec.users is not None and fit.codec.items is not None
    out = als.predict(fit, df)
    assert out.count() == 80 and out.agg(F.min("user_id")).first()[0] == big


def test_grid_search_results(planted):
    fit = als.grid_search(planted, [2], [3], [0.05, 0.1], num_folds=2, parallelism=2)
    rows = fit.results.collect()
    assert [r.reg_param for r in rows] == [0.05, 0.1]
    assert all(r.rmse > 0 for r in rows)


def test_rankings_and_uncut_precision(spark):
    scored = spark.createDataFrame(
        [(1, 1, 5.0, 0.1), (1, 2, 3.0, 0.9), (1, 3, 1.0, 0.5), (2, 4, 2.0, 1.0)],
        "user_id bigint, item_id bigint, rating double, predicted_rating double")
    r = {(x.user_id, x.item_id): (x.pred_rank, x.truth_rank) for x in als.rankings(scored).collect()}
    assert r[(1, 2)] == (1, 2) and r[(1, 1)] == (3, 1) and r[(2, 4)] == (1, 1)
    # degenerate: mean(min(k, n_u) / k) = (2/2 + 1/2) / 2
    assert als.precision_uncut(scored, 2).first()["precision"] == pytest.approx(0.75)


def test_unknown_ids_are_dropped(spark, tiny):
    fitted = als.fit(tiny, rank=2, max_iter=2)
    asked = spark.createDataFrame([(1, 10, 5.0), (99, 10, 5.0), (2**40, 10, 5.0)], tiny.schema)
    assert [r.user_id for r in als.predict(fitted, asked).collect()] == [1]


def test_blocks_follow_the_ratings_not_the_shuffle_partitions():
    assert als.block_count(2_400_000, 200) == 10
    assert als.block_count(144_000_000, 200) == 15
    assert als.block_count(144_000_000, 4) == 4 and als.block_count(0, 200) == 10


def test_a_fit_of_few_ratings_has_few_blocks(spark, tiny, monkeypatch):
    asked = []
    make = als.estimator
    monkeypatch.setattr(als, "estimator", lambda *args, **named: asked.append(args) or make(*args, **named))
    monkeypatch.setattr(als, "partition_count", lambda _: 40)
    als.fit(tiny, rank=2, max_iter=1)
    assert asked[0][4] == 10


def test_models_score_by_hash_joins_and_equal_the_plain_model(spark, planted):
    """Rows are sorted for no join, and every value is the library model's own."""
    from pyspark.ml.recommendation import ALSModel

    fitted = als.fit(planted.filter("item_id < 15 or user_id < 20"), rank=3, max_iter=2)
    asked = als.encode(planted.unionByName(planted.limit(3)).withColumn("user_id", F.col("user_id") + 5), fitted.codec)
    plain = ALSModel._transform(fitted.model, asked)
    for hashed in (False, True):
        ours = als.score(fitted.model, asked, hashed)
        assert sorted(map(str, ours.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan


def test_a_search_gives_back_the_disk_of_its_fits(spark, planted, monkeypatch):
    """Of some 130 shuffles of six fits and scorings, those of finished fits go while the search runs."""
    from kinrank.plans import context

    monkeypatch.setattr(context, "RECLAIM_EVERY", 0.0, raising=False)
    shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    before = shuffles.size()
    als.fold_table(planted, [2], [8], [0.05, 0.1, 0.2], num_folds=2, parallelism=1)
    left = shuffles.size() - before
    assert left < 75, left
