import pytest

from kinrank.operators import baseline


def test_item_means_and_rmse(tiny):
    stats = {r.item_id: r.avg_rating for r in baseline.item_stats(tiny).collect()}
    assert stats[10] == pytest.approx(10 / 3) and stats[20] == pytest.approx(10 / 3)
    assert stats[30] == pytest.approx(11 / 3) and stats[40] == pytest.approx(3.5)
    pred = baseline.predict(tiny, baseline.item_stats(tiny))
    assert baseline.rmse(pred).first()["rmse"] == pytest.approx(1.148121, abs=1e-6)


def test_empty_popular_list_scores_zero(tiny):
    stats = baseline.item_stats(tiny)
    assert baseline.popular_top_k(stats, 5).count() == 0
    assert baseline.precision_at_k(tiny, stats, 5).first()["precision"] == 0.0


def test_precision_cut_rule(spark):
    # popular: item 1 (3 ratings, mean 4.33), item 2 (2 ratings, mean 5)
    train = spark.createDataFrame(
        [(1, 1, 5.0), (2, 1, 4.0), (3, 1, 4.0), (1, 2, 5.0), (2, 2, 5.0)],
        "user_id bigint, item_id bigint, rating double")
    stats = baseline.item_stats(train)
    assert [r.item_id for r in baseline.popular_top_k(stats, 5).orderBy("rank").collect()] == [1, 2]
    # user 9 rated one item (item 2): popular list is cut to n+1 = 2 entries -> hit
    test = spark.createDataFrame([(9, 2, 3.0)], "user_id bigint, item_id bigint, rating double")
    assert baseline.precision_at_k(test, stats, 5).first()["precision"] == pytest.approx(1 / 5)


def test_truth_ranking_full_and_cut(tiny):
    full = baseline.user_truth_ranking(tiny)
    order = {}
    for r in full.orderBy("user_id", "rank").collect():
        order.setdefault(r.user_id, []).append(r.item_id)
    assert order[3] == [20, 40, 10] and order[1] == [10, 30, 20]
    cut = baseline.user_truth_ranking(tiny, k=1)
    assert {r.user_id: r.item_id for r in cut.collect()} == {1: 10, 2: 10, 3: 20, 4: 40}
