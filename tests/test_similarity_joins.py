"""Blocked similarity, hub-splitting joins and the sweep's arrays."""

import random

import pytest
from pyspark.sql import functions as F

from kinrank.functions import joins, metrics
from kinrank.operators import neighbors, similarity

RATINGS = "user_id bigint, item_id bigint, rating double"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def random_ratings(spark, seed=3, users=60, items=25, share=0.3):
    rnd = random.Random(seed)
    rows = [(u, i, rnd.randint(1, 10) / 2) for u in range(1, users) for i in range(items) if rnd.random() < share]
    rows += [(u, 1000, rnd.randint(1, 10) / 2) for u in range(1, users)]  # an item that everybody rated
    return spark.createDataFrame(rows, RATINGS)


def listed(df):
    return sorted((r.i, r.j, r.row_number, round(r.value, 9)) for r in df.collect())


@pytest.mark.parametrize("blocks", [1, 2, 5])
@pytest.mark.parametrize("symmetric", [False, True])
def test_blocked_top_lists_equal_the_pair_table(spark, blocks, symmetric):
    centered = neighbors.center(random_ratings(spark))
    want = neighbors.top_neighbors(neighbors.user_similarity(centered), 7, symmetric)
    got = similarity.blocked_top_neighbors(centered, 7, symmetric, blocks)
    assert listed(got) == listed(want)


def test_blocked_top_lists_against_mllib(spark):
    from pyspark.mllib.linalg.distributed import CoordinateMatrix, MatrixEntry

    centered = neighbors.center(random_ratings(spark, seed=9))
    entries = centered.rdd.map(lambda r: MatrixEntry(r.item_id, r.user_id, r.rating_norm))
    by_user = {}
    for e in CoordinateMatrix(entries).toRowMatrix().columnSimilarities().entries.collect():
        by_user.setdefault(e.i, []).append((-round(e.value, 9), e.j))
    want = {(i, j, rank): -v for i, all_ in by_user.items() for rank, (v, j) in enumerate(sorted(all_)[:5], 1)}
    got = {(r.i, r.j, r.row_number): r.value for r in similarity.blocked_top_neighbors(centered, 5, blocks=3).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_stripes_and_ties(spark, monkeypatch):
    """Stripes of a few products, sparse and dense, give the same lists; ties go to the smaller partner."""
    monkeypatch.setattr(similarity, "STRIPE", 50)
    rows = [(u, i, float(1 + (i + u) % 2)) for u in range(1, 30) for i in range(4)]
    centered = neighbors.center(spark.createDataFrame(rows, RATINGS)).toPandas()
    import numpy as np
    import pyarrow as pa

    norm = centered.groupby("user_id").rating_norm.transform(lambda x: (x**2).sum() ** 0.5)
    table = pa.table({
        "p": np.zeros(len(centered), int), "q": np.zeros(len(centered), int), "second": np.zeros(len(centered), bool),
        "user": centered.user_id.to_numpy(), "item": centered.item_id.to_numpy(), "x": (centered.rating_norm / norm).to_numpy()})
    got = similarity._pair_of_blocks(table, 3, False).to_pydict()
    lists = {}
    for i, j, v in sorted(zip(got["i"], got["j"], got["value"]), key=lambda t: (t[0], -round(t[2], 9), t[1])):
        lists.setdefault(i, []).append((j, round(v, 9)))
    # users of one parity are equal (cosine 1), of the other opposite (-1)
    assert lists[1] == [(3, 1.0), (5, 1.0), (7, 1.0)] and lists[26] == [(28, 1.0), (27, -1.0), (29, -1.0)]
    assert 29 not in lists


def test_no_pair_table_crosses_the_shuffle(spark):
    """At most k rows of a user per block leave the tasks that multiply."""
    centered = neighbors.center(random_ratings(spark))
    partial = similarity.partial_top_lists(centered, 4, blocks=3)
    most = partial.groupBy("i").count().agg(F.max("count")).first()[0]
    assert most <= 4 * 3
    plan = plan_of(similarity.blocked_top_neighbors(centered, 4, blocks=3))
    assert "FlatMapGroupsInArrow" in plan and "WindowGroupLimit" in plan and "SortMergeJoin [item_id" not in plan


def test_empty_and_flat_ratings_have_no_neighbours(spark):
    flat = neighbors.center(spark.createDataFrame([(1, 1, 3.0), (2, 1, 3.0)], RATINGS))
    assert similarity.blocked_top_neighbors(flat).collect() == []
    assert similarity.blocked_top_neighbors(flat.filter("false")).collect() == []


def test_pair_similarity_of_asked_pairs(spark):
    centered = neighbors.center(random_ratings(spark))
    every = {(r.i, r.j): r.value for r in neighbors.user_similarity(centered).collect()}
    asked = [(1, 2), (1, 2), (2, 1), (5, 40), (3, 9999)]
    got = {(r.i, r.j): r.value for r in similarity.pair_similarity(
        centered, spark.createDataFrame(asked, "i bigint, j bigint")).collect()}
    assert set(got) == set(asked) and got[(3, 9999)] is None
    for i, j in [(1, 2), (2, 1), (5, 40)]:
        assert got[(i, j)] == pytest.approx(every[(min(i, j), max(i, j))])


# ------------------------------------------------------------------ split joins


@pytest.fixture
def low_limits(monkeypatch):
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 200)
    monkeypatch.setattr(joins, "SMALL_OUTPUT", 0)
    monkeypatch.setattr(neighbors, "ROWS_PER_TASK", 200)


@pytest.mark.parametrize("few", [True, False])
def test_split_join_equals_plain(spark, low_limits, monkeypatch, few):
    if not few:
        monkeypatch.setattr(joins, "BROADCAST_KEYS", 0)
    left = spark.createDataFrame([(1, x) for x in range(300)] + [(2, 0), (3, 1)] + [(4, 7)], "k int, a int")
    right = spark.createDataFrame([(1, y) for y in range(10)] + [(2, y) for y in range(500)] + [(3, 5)], "k int, b int")
    loads = joins.measure(left, right, "k")
    assert loads.total == 3000 + 500 + 1 and loads.few == few
    parts = {r.k: (r._left_parts, r._right_parts) for r in loads.hot.collect()}
    assert parts == {1: (15, 1), 2: (1, 3)}
    got = joins.split_join(left, right, ["k"], "k", loads)
    assert got.columns == ["k", "a", "b"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    rows = got.withColumn("p", F.spark_partition_id()).filter("k = 1").groupBy("p").count().collect()
    assert len(rows) > 4 and max(r["count"] for r in rows) < 1500


def hub_model(spark, users=400):
    """One neighbour that every user has; it rated every item."""
    users_ = range(1, users + 1)
    means = spark.createDataFrame([(u, 3.0) for u in users_], "user_id bigint, user_mean double")
    centered = spark.createDataFrame(
        [(i, users, 0.25 * i) for i in range(20)], "item_id bigint, user_id bigint, rating_norm double")
    top = spark.createDataFrame([(u, users, 0.5, 1) for u in users_ if u != users], "i bigint, j bigint, value double, row_number int")
    return neighbors.NeighborModel(means, centered, top, spark.createDataFrame([(i,) for i in range(20)], "item_id bigint"))


def test_a_hub_neighbour_is_spread_over_tasks(spark, low_limits):
    model = hub_model(spark)
    keys = model.means.filter("user_id < 400").select("user_id").crossJoin(model.catalogue)
    found = neighbors._contributions(model, keys, 5)
    tasks = found.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert sum(t["count"] for t in tasks) == 399 * 20
    # one (neighbour, item) key has 399 rows; the hub as a whole 7980: no task holds a fifth of them
    assert len(tasks) > 8 and max(t["count"] for t in tasks) < 399 * 4
    pred = neighbors.predict(model, keys, 5)
    assert pred.count() == 399 * 20
    assert pred.filter(F.abs(F.col("prediction") - (3.0 + 0.125 * F.col("item_id"))) > 1e-12).count() == 0


def test_a_hub_neighbour_in_recommendations(spark, low_limits):
    model = hub_model(spark)
    recs = neighbors.recommend(model, model.means, 5, 3)
    got = {}
    for r in recs.orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append((r.item_id, r.score))
    assert all(got[u] == [(19, 3 + 0.125 * 19), (18, 3 + 0.125 * 18), (17, 3 + 0.125 * 17)] for u in range(1, 400))
    assert [i for i, _ in got[400]] == [19, 18, 17] and len(got) == 400


def test_a_user_who_asks_for_most_pairs_is_split(spark, low_limits):
    ratings = random_ratings(spark, share=0.5)
    model = neighbors.fit(ratings, 10)
    asked = spark.createDataFrame([(1, i) for i in range(25)] * 1 + [(2, 3)], "user_id bigint, item_id bigint")
    want = {(r.user_id, r.item_id): r.prediction for r in neighbors.predict(model._replace(rated=None), asked, 10).collect()}
    got = {(r.user_id, r.item_id): r.prediction for r in neighbors.predict(model, asked, 10).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_refit_reads_the_similarity_without_an_exchange(spark):
    """NB11: the bucketed neighbour list is scanned, filtered and joined where it lies."""
    ratings = random_ratings(spark)
    model = neighbors.fit(ratings, 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(neighbors.active_neighbors(model.top, 3).withColumnRenamed("i", "user_id").join(
            ratings.select("user_id").distinct(), "user_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and "Exchange hashpartitioning(i" not in plan


# ------------------------------------------------------------------ sweep by arrays


def test_sweep_equals_predict_at_every_count(spark):
    """Also for users in the id range without ratings (padded) and unknown items."""
    ratings = random_ratings(spark, users=30).filter("user_id <> 7")
    model = neighbors.fit(ratings, 10)
    frame = spark.createDataFrame(
        [(u, i, float(i % 5)) for u in (1, 2, 7, 29, 50) for i in (0, 3, 1000, 5555)], RATINGS)
    swept = {}
    for r in neighbors.sweep_predictions(model, frame, 6).collect():
        swept[(r.n, r.user_id, r.item_id)] = r.prediction
    assert len(swept) == 6 * 20
    for n in (1, 4, 6):
        for r in neighbors.predict(model, frame, n).collect():
            assert swept[(n, r.user_id, r.item_id)] == (None if r.prediction is None else pytest.approx(r.prediction))
    assert swept[(3, 7, 0)] == neighbors.GAP_USER_RATING and swept[(3, 50, 0)] is None and swept[(3, 1, 5555)] is None
    curve = {r.n: r.rmse for r in neighbors.sweep(model, frame, 6, 2).collect()}
    assert curve[4] == pytest.approx(metrics.rmse(neighbors.predict(model, frame, 4)).first()["rmse"])


def test_error_curve_multiplies_no_row(spark):
    model = neighbors.fit(random_ratings(spark), 10)
    frame = random_ratings(spark, seed=5)
    curve = neighbors.error_curve(model, frame.withColumn("fold", F.col("item_id") % 2), 5, ["fold"])
    plan = plan_of(curve)
    assert plan.count("Generate") == 1  # the averages of a group become rows, nothing before
    want = metrics.rmse_by(neighbors.predict(model, frame, 3).withColumn("fold", F.col("item_id") % 2), "fold")
    want = {r.fold: r.rmse for r in want.collect()}
    got = {r.fold: r.rmse for r in curve.filter("n = 3").collect()}
    assert got == pytest.approx(want)


def test_coverages_share_the_lists(spark):
    ratings = random_ratings(spark)
    model = neighbors.fit(ratings, 10)
    part = ratings.filter("user_id < 20")
    both = neighbors.coverages(model, {"all": ratings, "part": part}, 5, 3)
    assert both["all"].first()[0] == neighbors.coverage(model, ratings, 5, 3).first()[0]
    assert both["part"].first()[0] == neighbors.coverage(model, part, 5, 3).first()[0]


def test_bitmap_coverage_counts_distinct_items(spark):
    """Numbers across several bitmaps, repeated in many lists."""
    recs = spark.range(300_000).select((F.col("id") % 70_001 + 1).alias("number"), F.col("id").alias("user_id"))
    frame = spark.range(0, 90_000).select((F.col("id") % 80_000).alias("item_id"))
    out = metrics.bitmap_coverage(recs, frame, "number")
    assert out.first()["coverage"] == 70_001 / 80_000
    plan = plan_of(out)
    assert "partial_bitmap_construct_agg" in plan
    assert metrics.bitmap_coverage(recs.filter("false"), frame, "number").first()["coverage"] == 0.0


# ------------------------------------------------------------------ what is sent


@pytest.mark.parametrize("hot", [10_000, 5])
def test_entries_go_only_to_blocks_that_rate_the_item(spark, monkeypatch, hot):
    """Pairs of users with an item of their own: at most two blocks of 30 are reached."""
    monkeypatch.setattr(similarity, "HOT_RATERS", hot)
    rows = [(u, u // 2, 1.0, u % 30) for u in range(200)] + [(900 + u, 500, 1.0, u) for u in range(8)]
    entries = spark.createDataFrame(rows, "user bigint, item bigint, x double, own int")
    sent = {(r.item < 500, r["count"]) for r in similarity._dealt(entries, 30, 3).groupBy("item", "user").count().collect()}
    assert sent == {(True, 2), (False, 8 if hot > 8 else 30)}


def test_blocked_top_lists_with_hot_items(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HOT_RATERS", 20)
    centered = neighbors.center(random_ratings(spark))
    want = neighbors.top_neighbors(neighbors.user_similarity(centered), 7)
    assert listed(similarity.blocked_top_neighbors(centered, 7, blocks=5)) == listed(want)


@pytest.mark.parametrize("pack", [2, 1_000])
def test_recommended_lists_come_from_one_shuffle_of_packed_ratings(spark, monkeypatch, pack):
    """Every catalogue item scored by hand; nothing but small tables is written on the way."""
    monkeypatch.setattr(neighbors, "PACK", pack)
    ratings = random_ratings(spark, users=20, items=12)
    model = neighbors.fit(ratings)
    written = []
    monkeypatch.setattr(neighbors, "materialize", lambda df, *a: written.append(df) or df)
    got = {}
    for r in neighbors.recommend(model, ratings, 4, 6).collect():
        got.setdefault(r.user_id, {})[r.rank] = (r.item_id, round(r.score, 6))
    assert not written
    means = {r.user_id: r.user_mean for r in model.means.collect()}
    items = [r.item_id for r in model.catalogue.collect()]
    rated = {(r._v, r.item_id): r._x for r in model.rated.collect()}
    lists = {}
    for r in model.top.filter("row_number <= 4").collect():
        lists.setdefault(r.i, []).append((r.j, r.value))
    for user, mean in means.items():
        scores = {m: mean + sum(s * rated.get((v, m), 0.0) for v, s in lists.get(user, [])) for m in items}
        best = sorted(items, key=lambda m: (-round(scores[m], 9), -m))[:6]
        assert got[user] == {n: (m, round(scores[m], 6)) for n, m in enumerate(best, 1)}


def test_large_sides_of_predictions_are_not_broadcast(spark):
    ratings = random_ratings(spark, users=20, items=8)
    model = neighbors.fit(ratings)
    # Only the lookup by (neighbour, item), small here, is left to the planner.
    assert plan_of(neighbors.predict(model, ratings, 3)).count("BroadcastExchange") <= 1


@pytest.mark.parametrize("symmetric", [False, True])
def test_pairs_give_the_lists_of_the_blocks(spark, symmetric):
    rows = random_ratings(spark, seed=21)
    odd = spark.createDataFrame([(3, 1000, 2.0), (4, 2000, 1.0), (5, None, 1.0), (2**40, 1000, 5.0), (2**40, 7, 1.0)],
                                "user_id bigint, item_id bigint, rating double")
    centered = neighbors.center(rows.unionByName(odd))
    load = similarity.pair_load(centered)
    assert load.high == 2**40
    got = similarity.pair_top_lists(centered, load, 7, symmetric)
    assert listed(got) == listed(similarity.blocked_top_neighbors(centered, 7, symmetric, blocks=4))


def test_pairs_or_blocks_by_what_they_send(spark, monkeypatch):
    centered = neighbors.center(random_ratings(spark))
    asked = []
    real = similarity.pair_top_lists
    monkeypatch.setattr(similarity, "pair_top_lists", lambda *a: asked.append(a) or real(*a))
    pairs = listed(similarity.blocked_top_neighbors(centered, 7))
    assert len(asked) == 1
    monkeypatch.setattr(similarity, "PAIR_RATERS", 10)
    assert listed(similarity.blocked_top_neighbors(centered, 7)) == pairs and len(asked) == 1
    one_block = similarity.PairLoad(entries=10_000, pairs=10_000_000, most=3_000, low=1, high=9)
    monkeypatch.setattr(similarity, "PAIR_RATERS", 5_000)
    assert not similarity._by_pairs(one_block, 1, False, 2)


def test_a_task_of_the_pair_table_adds_up_a_bounded_number_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PAIRS_PER_TASK", 200)
    centered = neighbors.center(random_ratings(spark))
    load = similarity.pair_load(centered)
    sums = neighbors.user_similarity(centered)
    assert sums.rdd.getNumPartitions() == -(-load.pairs // 200) > 4
    plain = neighbors.user_similarity(centered, salt_buckets=1)
    as_map = lambda df: {(r.i, r.j): round(r.value, 9) for r in df.collect()}
    assert as_map(sums) == as_map(plain)


def test_asked_items_travel_packed(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "PACK", 2)
    rows = random_ratings(spark, seed=5)
    model = neighbors.fit(rows)
    keys = rows.select("user_id", "item_id").distinct()
    got = {(r.user_id, r.item_id, r._r): round(r._c, 9) for r in neighbors._contributions(model, keys, 5).collect()}
    plain = keys.join(neighbors._active(model, 5), "user_id").join(neighbors._rated(model), ["_v", "item_id"])
    want = {(r.user_id, r.item_id, r._r): round(r._sim * r._x, 9) for r in plain.collect()}
    assert got == want and len(got) > 100
    packs = neighbors._asked_packs(keys)
    assert packs.agg(F.max(F.size("_asks"))).first()[0] == 2


def test_sweep_cuts_where_the_user_lies(spark, monkeypatch):
    rows = random_ratings(spark, seed=6)
    model = neighbors.fit(rows)
    at_home = {r.n: (r.rmse, r.precision) for r in neighbors.sweep(model, rows, 4, 3).collect()}
    monkeypatch.setattr(neighbors, "ROWS_PER_TASK", 1)
    on_the_way = {r.n: (r.rmse, r.precision) for r in neighbors.sweep(model, rows, 4, 3).collect()}
    assert at_home.keys() == {1, 2, 3, 4}
    assert all(at_home[n] == pytest.approx(on_the_way[n]) for n in at_home)
