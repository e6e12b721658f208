"""Nested samples, the published result sets and the fold table."""

import duckdb
import pytest
from pyspark.sql import functions as F

from kinrank.operators import als, prepare
from kinrank.plans import data, experiments
from kinrank.plans.context import shared_dir
from kinrank.sources.results import ResultStore
from kinrank.sources import ratings as src

SF = "/root/testdata/sf0.001"
RATINGS = "user_id bigint, item_id bigint, rating double, ts date"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_nested_samples_equal_each_size_alone(spark):
    ratings, items = src.standin_ratings(spark, SF), src.standin_items(spark, SF)
    total = ratings.count()
    sizes = [total // 3, 2 * total // 3, total]
    nested = prepare.nested_samples(ratings, items, sizes)
    splits = data.nested_splits(ratings, items, sizes)
    for size in sizes:
        alone = prepare.clean_ratings(ratings, items, size).select(*ratings.columns)
        assert rows_of(nested.filter(F.col("sample_size") == size).drop("sample_size")) == rows_of(alone)
        want = data.materialized_split(ratings, items, size)
        assert [rows_of(x.select(*ratings.columns)) for x in splits[size]] == [
            rows_of(x.select(*ratings.columns)) for x in want]


def test_a_size_is_read_from_its_own_folder(spark):
    ratings, items = src.standin_ratings(spark, SF), src.standin_items(spark, SF)
    train, _ = data.nested_splits(ratings, items, [2000, 4000])[4000]
    plan = train._jdf.queryExecution().executedPlan().toString()
    pruned = plan[plan.index("PartitionFilters"):].split("]", 1)[0]
    assert "sample_size" in pruned and "_part" in pruned


@pytest.fixture
def store(spark, tmp_path):
    return ResultStore(spark, str(tmp_path / "results"))


def frame(spark, value):
    return spark.createDataFrame([(1, value), (2, value + 1)], "user_id bigint, rmse double")


def test_published_sets_are_read_by_model_and_size_in_order(spark, store):
    for model in ("baseline", "neighbor"):
        for size in (300, 100, 200):
            store.publish(model, size, {"rmse_user": frame(spark, size / 100)})
    got = store.load("rmse_user", ["neighbor"], [200, 100, 300], ["model", "sample_size", "rmse"]).collect()
    assert [r.sample_size for r in got] == [100, 100, 200, 200, 300, 300]
    assert {r.model for r in got} == {"neighbor"} and {r.rmse for r in got if r.sample_size == 200} == {2.0, 3.0}
    assert store.load("rmse_user").count() == 12
    plan = store.load("rmse_user", ["baseline"], [100, 300])._jdf.queryExecution().executedPlan().toString()
    pruned = plan[plan.index("PartitionFilters"):].split("]", 1)[0]
    assert "sample_size" in pruned and "model" in pruned and "version" in pruned
    read = store.load("rmse_user", ["baseline"], [100, 300])
    assert len(read.inputFiles()) > 0 and read.count() == 4


def test_only_the_selected_folders_are_scanned(spark, store):
    for size in (1, 2, 3):
        store.publish("neighbor", size, {"rmse_user": frame(spark, 0.0).coalesce(1)})
    df = store.load("rmse_user", ["neighbor"], [1, 3])
    df.collect()
    scans = df._jdf.queryExecution().executedPlan().collectLeaves()
    metrics = scans.head().metrics()
    assert metrics.apply("numFiles").value() == 2 and metrics.apply("numPartitions").value() == 2


def test_a_later_set_replaces_the_earlier_whole(spark, store):
    store.publish("neighbor", 100, {"rmse_user": frame(spark, 1.0), "summary": frame(spark, 9.0)})
    store.publish("neighbor", 100, {"rmse_user": frame(spark, 2.0)})
    assert sorted(r.rmse for r in store.load("rmse_user").collect()) == [2.0, 3.0]
    with pytest.raises(LookupError):
        store.load("summary")  # the latest set has none: sets are not mixed
    assert store.vacuum() == 1 and len(store.published()) == 1
    assert store.load("rmse_user").count() == 2


def test_a_failed_publish_shows_nothing(spark, store):
    store.publish("neighbor", 100, {"rmse_user": frame(spark, 1.0)})
    broken = frame(spark, 5.0).withColumn("rmse", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        store.publish("neighbor", 100, {"rmse_item": frame(spark, 7.0), "rmse_user": broken})
    assert sorted(r.rmse for r in store.load("rmse_user").collect()) == [1.0, 2.0]
    with pytest.raises(ValueError):
        store.publish("neighbor", 100, {"other": frame(spark, 1.0)})
    with pytest.raises(LookupError):
        store.load("rmse_user", ["als"])


def planted(spark):
    import random

    rnd = random.Random(2)
    rows = [(u, i, 1.0 + (u % 4) * 0.5 + (i % 5) * 0.5 + rnd.choice([0, 0.5])) for u in range(40) for i in range(25)
            if rnd.random() < 0.6]
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double")


def test_fold_table_against_sql_over_the_written_predictions(spark, tmp_path):
    train = planted(spark)
    regs = [0.05, 0.2, 1.0]
    folder = str(tmp_path / "predictions")
    table = als.fold_table(train, [4], [3], regs, num_folds=2, predictions=folder)
    got = {(r.fold, r.reg_param): (r.n, round(r.rmse, 6)) for r in als.fold_curve(table).collect()}
    con = duckdb.connect()
    sql = f"""select fold::int as fold, reg_param::double as reg_param, count(*) as n, round(sqrt(avg(power(rating - prediction, 2))), 6) as rmse
              from read_parquet('{folder}/*/*/*/*/*.parquet', hive_partitioning = true) group by all"""
    want = {(f, r): (n, e) for f, r, n, e in con.execute(sql).fetchall()}
    assert got.keys() == want.keys() and len(got) == 6
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-5) for k in got)
    mean = f"""with c as ({sql}), m as (select reg_param, avg(rmse) as rmse from c group by 1)
               select reg_param, rmse from m order by round(rmse, 9), reg_param limit 1"""
    best, lowest = con.execute(mean).fetchone()
    ours = experiments.best_params(als.mean_curve(table), "reg_param", low="rmse").first()
    assert ours.best_reg_param_rmse == best and ours.min_rmse == pytest.approx(lowest, abs=1e-5)
    # the heavy penalty is worse than the light one on a planted matrix, and the fit takes the best
    assert ours.best_reg_param_rmse < 1.0
    assert als.fit_best(train, table).model.rank == 4


def test_fold_table_means_are_the_cross_validators(spark):
    train = planted(spark)
    regs = [0.1, 0.5]
    mean = {round(r.reg_param, 2): r.rmse for r in als.mean_curve(als.fold_table(train, [4], [3], regs)).collect()}
    searched = {r.reg_param: r.rmse for r in als.grid_search(train, [4], [3], regs).results.collect()}
    assert mean.keys() == searched.keys()
    assert all(mean[k] == pytest.approx(searched[k], abs=2e-3) for k in mean)


def test_als_study_publishes_five_kinds(spark):
    ratings, items = src.standin_ratings(spark, SF), src.standin_items(spark, SF)
    store = ResultStore(spark, f"{shared_dir(spark)}/als-study-test")
    experiments.run_study(store, ratings, items, [ratings.count()],
                          {"als": {"reg_params": [0.1, 0.3], "rank": 3, "max_iter": 2}})
    assert {r.param for r in store.load("curve", ["als"]).collect()} == {0.1, 0.3}
    row = store.load("summary", ["als"]).first()
    assert row.runtime > 0 and 0 < row.rmse_train < row.rmse_test and 0 < row.coverage_test <= 1
    by_user = store.load("rmse_user")
    assert by_user.count() == store.load("precision_user").count() > 0
    assert store.load("rmse_item").count() > 0


def test_rankings_number_one_table_twice(spark):
    scored = spark.createDataFrame(
        [(u, i, float((u * i) % 5), float((u + i) % 4)) for u in range(1, 8) for i in range(12)],
        "user_id bigint, item_id bigint, rating double, predicted_rating double")
    got = {(r.user_id, r.item_id): (r.pred_rank, r.truth_rank) for r in als.rankings(scored).collect()}
    for u in range(1, 8):
        pred = sorted(range(12), key=lambda i: (-((u + i) % 4), -i))
        truth = sorted(range(12), key=lambda i: (-((u * i) % 5), -i))
        assert [got[u, i] for i in range(12)] == [(pred.index(i) + 1, truth.index(i) + 1) for i in range(12)]


def test_rankings_write_once_and_cross_one_shuffle(spark, monkeypatch):
    scored = spark.createDataFrame(
        [(u, i, float((u * i) % 5), float((u + i) % 4)) for u in range(1, 6) for i in range(9)] + [(None, 1, 1.0, 1.0)],
        "user_id bigint, item_id bigint, rating double, predicted_rating double")
    monkeypatch.setattr(als, "group_row_number", None)
    ranks = als.rankings(scored)
    plan = ranks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan and "Join" not in plan
    at_home = rows_of(ranks)
    monkeypatch.undo()
    monkeypatch.setattr(als, "ROWS_PER_TASK", 3)  # every user is too long for one task
    assert rows_of(als.rankings(scored)) == at_home and len(at_home) == 45


def test_steps_run_side_by_side_and_a_failure_comes_out(spark):
    from threading import Barrier

    from kinrank.plans.context import together

    both = Barrier(2, timeout=60)  # passes only while both wait

    def step(value):
        both.wait()
        return value

    assert together(spark, {"a": lambda: step(1), "b": lambda: step(2)}) == {"a": 1, "b": 2}
    assert together(spark, {}) == {}
    with pytest.raises(ZeroDivisionError):
        together(spark, {"a": lambda: 1 // 0})


def test_steps_of_a_study_run_side_by_side(spark, monkeypatch):
    asked = []
    make = experiments.together
    monkeypatch.setattr(experiments, "together", lambda s, steps: asked.append(set(steps)) or make(s, steps))
    train = planted(spark).select("user_id", "item_id", "rating")
    kinds = experiments.neighbor_results(train, train, 3, 2, 2, 3)
    assert asked == [{"train", "test", "covered", "curve"}]
    assert set(kinds) == {"rmse_user", "rmse_item", "precision_user", "curve", "summary"}
    assert kinds["summary"].first().rmse_train == pytest.approx(kinds["summary"].first().rmse_test)
