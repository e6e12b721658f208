"""Hand-checked fixture (FIXTURES.md §4) for the neighbourhood model."""

import pytest

from kinrank.functions import metrics
from kinrank.operators import neighbors


def as_map(df, key, val):
    return {r[key]: r[val] for r in df.collect()}


def test_user_means(tiny):
    assert as_map(neighbors.user_mean(tiny), "user_id", "user_mean") == {1: 4, 2: 3, 3: 3, 4: 4}


def test_similarity(tiny):
    sim = neighbors.user_similarity(neighbors.center(tiny))
    got = {(r.i, r.j): r.value for r in sim.collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3)}
    assert got[(1, 2)] == pytest.approx(1)
    assert got[(1, 3)] == pytest.approx(-1)
    assert got[(2, 3)] == pytest.approx(-1)


def test_salted_similarity_equals_plain(tiny):
    plain = neighbors.user_similarity(neighbors.center(tiny))
    salted = neighbors.user_similarity(neighbors.center(tiny), salt_buckets=3)
    a = {(r.i, r.j): round(r.value, 12) for r in plain.collect()}
    b = {(r.i, r.j): round(r.value, 12) for r in salted.collect()}
    assert a == b


def preds(model, tiny, n):
    return {(r.user_id, r.item_id): r.prediction for r in neighbors.predict(model, tiny, n).collect()}


def test_predictions_one_and_two_neighbours(tiny):
    model = neighbors.fit(tiny)
    p1 = preds(model, tiny, 1)
    assert p1[(1, 10)] == pytest.approx(5) and p1[(1, 20)] == pytest.approx(3)
    assert p1[(2, 10)] == pytest.approx(5) and p1[(2, 20)] == pytest.approx(1)
    assert p1[(3, 10)] == pytest.approx(3) and p1[(4, 30)] == pytest.approx(4)
    p2 = preds(model, tiny, 2)
    assert p2[(1, 10)] == pytest.approx(7)  # not clipped
    assert p2[(1, 20)] == pytest.approx(1)


def test_unknown_item_gives_null(spark, tiny):
    model = neighbors.fit(tiny)
    asked = spark.createDataFrame([(1, 99), (1, 10)], "user_id bigint, item_id bigint")
    got = {r.item_id: r.prediction for r in neighbors.predict(model, asked, 1).collect()}
    assert got[99] is None and got[10] == pytest.approx(5)


def test_rmse_total_user_item(tiny):
    model = neighbors.fit(tiny)
    p1 = neighbors.predict(model, tiny, 1)
    total, by_user, by_item = neighbors.rmse_report(p1)
    assert total.first()["rmse"] == pytest.approx(0.953463, abs=1e-6)
    assert neighbors.metrics.rmse(neighbors.predict(model, tiny, 2)).first()["rmse"] == pytest.approx(
        1.279204, abs=1e-6)
    u = as_map(by_user, "user_id", "rmse")
    assert [round(u[k], 6) for k in (1, 2, 3, 4)] == [0, 0.816497, 1.632993, 0]
    i = as_map(by_item, "item_id", "rmse")
    assert [round(i[k], 6) for k in (10, 20, 30, 40)] == [1.290994, 1.290994, 0, 0]


def test_precision_top2(tiny):
    model = neighbors.fit(tiny)
    prec = neighbors.precision_by_user(neighbors.predict(model, tiny, 1), 2)
    assert as_map(prec, "user_id", "precision") == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0}


def test_recommendations_and_coverage(tiny):
    model = neighbors.fit(tiny)
    recs = neighbors.recommend(model, tiny, 1, 2)
    lists = {}
    for r in recs.orderBy("user_id", "rank").collect():
        lists.setdefault(r.user_id, []).append(r.item_id)
    assert lists == {1: [10, 40], 2: [10, 40], 3: [40, 30], 4: [40, 30]}
    assert neighbors.coverage(model, tiny, 1, 2).first()["coverage"] == pytest.approx(0.75)


def test_sweep_matches_refits(tiny):
    model = neighbors.fit(tiny)
    sw = {r.n: (r.rmse, r.precision) for r in neighbors.sweep(model, tiny, 3, 2).collect()}
    for n in (1, 2, 3):
        p = neighbors.predict(model, tiny, n)
        assert sw[n][0] == pytest.approx(metrics.rmse(p).first()["rmse"])
        prec = metrics.mean_of(neighbors.precision_by_user(p, 2), "precision").first()["precision"]
        assert sw[n][1] == pytest.approx(prec)


def test_upper_triangle_and_symmetric(tiny):
    sim = neighbors.user_similarity(neighbors.center(tiny))
    top = neighbors.top_neighbors(sim, 100)
    assert all(r.i < r.j for r in top.collect())
    sym = neighbors.top_neighbors(sim, 100, symmetric=True)
    assert {(r.i, r.j) for r in sym.collect()} >= {(2, 1), (3, 1), (3, 2)}


def test_gap_user_defaults(spark):
    train = spark.createDataFrame([(1, 1, 3.0), (4, 1, 2.0)], "user_id bigint, item_id bigint, rating double")
    assert [tuple(r) for r in neighbors.gap_user_defaults(train).collect()] == [(2, 3, 0.5)]


def test_absent_users_in_the_id_range_get_the_padded_rating(spark):
    schema = "user_id bigint, item_id bigint, rating double"
    train = spark.createDataFrame([(1, 1, 3.0), (1, 2, 1.0), (5, 1, 2.0)], schema)
    model = neighbors.fit(train)
    asked = spark.createDataFrame([(3, 1), (3, 9), (6, 1), (-1, 1), (5, 2)], "user_id bigint, item_id bigint")
    got = {(r.user_id, r.item_id): r.prediction for r in neighbors.predict(model, asked, 20).collect()}
    assert got == {(3, 1): 0.5, (3, 9): None, (6, 1): None, (-1, 1): None, (5, 2): 2.0}


def test_duplicate_ratings_are_averaged_for_prediction(spark):
    schema = "user_id bigint, item_id bigint, rating double"
    centred = spark.createDataFrame([(2, 1, 0.5), (2, 1, 0.0)], "user_id bigint, item_id bigint, rating_norm double")
    means = spark.createDataFrame([(1, 4.0), (2, 3.0)], "user_id bigint, user_mean double")
    top = spark.createDataFrame([(1, 2, 0.5, 1)], "i bigint, j bigint, value double, row_number int")
    model = neighbors.NeighborModel(means, centred, top, spark.createDataFrame([(1,)], "item_id bigint"))
    asked = spark.createDataFrame([(1, 1, 5.0)], schema)
    assert neighbors.predict(model, asked, 1).first().prediction == 4.0 + 0.5 * 0.25


def test_auto_salting_splits_hot_items(tiny):
    plain = neighbors.user_similarity(neighbors.center(tiny), salt_buckets=1)
    # every item is "hot" at threshold 1: each is split into c blocks
    hot = neighbors.user_similarity(neighbors.center(tiny), salt_buckets="auto", hot_raters=1)
    a = {(r.i, r.j): round(r.value, 12) for r in plain.collect()}
    b = {(r.i, r.j): round(r.value, 12) for r in hot.collect()}
    assert a == b


def test_similarity_matches_mllib_column_similarities(spark):
    """NB3 against MLlib's exact columnSimilarities on a random sparse matrix."""
    import random

    from pyspark.mllib.linalg.distributed import CoordinateMatrix, MatrixEntry

    rnd = random.Random(7)
    rows = sorted({(u, i) for u in range(1, 25) for i in range(15) if rnd.random() < 0.4})
    data = [(u, i, float(rnd.randint(1, 10)) / 2) for u, i in rows]
    df = spark.createDataFrame(data, "user_id bigint, item_id bigint, rating double")
    centered = neighbors.center(df)
    ours = {(r.i, r.j): r.value for r in neighbors.user_similarity(centered).collect()}
    entries = centered.rdd.map(lambda r: MatrixEntry(r.item_id, r.user_id, r.rating_norm))
    ref = CoordinateMatrix(entries).toRowMatrix().columnSimilarities().entries.collect()
    theirs = {(e.i, e.j): e.value for e in ref}
    assert set(ours) == set(theirs)
    for k, v in theirs.items():
        assert ours[k] == pytest.approx(v, abs=1e-9)


def test_results_independent_of_partitioning(tiny):
    a = neighbors.predict(neighbors.fit(tiny), tiny, 2)
    b = neighbors.predict(neighbors.fit(tiny.repartition(7)), tiny.repartition(3), 2)
    key = lambda df: sorted((r.user_id, r.item_id, round(r.prediction, 9)) for r in df.collect())
    assert key(a) == key(b)


def test_similarity_in_range_and_i_lt_j(spark):
    from kinrank.plans import data

    train, _ = data.train_test(spark, "/root/testdata/sf0.001")
    sim = neighbors.user_similarity(neighbors.center(train))
    bad = sim.filter((sim.i >= sim.j) | (sim.value > 1 + 1e-9) | (sim.value < -1 - 1e-9)).count()
    assert bad == 0 and sim.count() > 0


def test_candidates_of_packed_lists_equal_brute_force():
    """Users across batches, several packs of a position, a null rating, ties, users of few candidates."""
    import numpy as np
    import pyarrow as pa

    rng, k, rows = np.random.default_rng(4), 3, []
    for user in (1, 2, 5, 9):
        for _ in range(user % 5 + 1):
            ds = sorted(rng.choice(30, rng.integers(1, 12), replace=False).tolist())
            xs = [None if rng.random() < 0.2 else round(float(rng.integers(1, 4)), 1) for _ in ds]
            rows.append((user, user / 2, 0.5, [d + 1 for d in ds], xs))
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 4]), kinds)], names=list("umsdx"))
        for i in range(0, len(rows), 4)]
    got = {r["user_id"]: r for b in neighbors._candidates(iter(batches), k) for r in b.to_pylist()}
    assert sorted(got) == [1, 2, 5, 9]
    for user, row in got.items():
        sums = {}
        for _, mean, sim, ds, xs in (r for r in rows if r[0] == user):
            for d, x in zip(ds, xs):
                sums.setdefault(d, []).extend([] if x is None else [sim * x])
        scores = {d: mean + sum(v) if v else None for d, v in sums.items()}
        assert row["_taken"] == [d for r, d in enumerate(sorted(scores), 1) if d - r < k]
        order = sorted(scores, key=lambda d: (scores[d] is None, -(scores[d] or 0.0), d))[:k]
        assert [(x["_d"], x["score"]) for x in row["_best"]] == [(d, pytest.approx(scores[d]) if scores[d] is not None else None) for d in order]
