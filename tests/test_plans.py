"""Physical-plan properties the scale design relies on."""

from kinrank.operators import neighbors
from kinrank.plans import data
from kinrank.sources import ratings as src

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_neighbors_limits_before_the_shuffle(spark):
    train, _ = data.train_test(spark, SF)
    top = neighbors.top_neighbors(neighbors.user_similarity(neighbors.center(train)), 100)
    plan = plan_of(top)
    assert "WindowGroupLimit" in plan and "Partial" in plan
    # the pair sums are pre-aggregated before their shuffle
    assert "partial_sum" in plan
    # hot-item salting: the self-join is keyed on (item, block_a, block_b)
    assert "_sa" in plan and "_sb" in plan


def test_recommendation_top_k_is_partial(spark):
    train, _ = data.train_test(spark, SF)
    model = neighbors.fit(train)
    plan = plan_of(neighbors.recommend(model, train, 20, 5))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_prunes_columns(spark):
    plan = plan_of(src.standin_ratings(spark, SF))
    # lineitem is read with only the columns the rating needs
    assert "l_returnflag" not in plan and "l_tax" not in plan
    assert "l_shipdate" in plan
