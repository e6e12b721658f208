"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (through the stand-in ratings and
items) over their whole extent.  Outputs round doubles to 6 places and
use BIGINT / DOUBLE / STRING so that an independent SQL engine can be
compared value for value (see ``plans/oracle.py``).

Study settings (fixed values): split seed 12345, 80/20; baseline and
neighbour precision at k = 5; neighbour coverage at k = 10; 20 neighbours
for the model and 100 kept per user; neighbour sweep 1..30; 10 quantile
buckets; ALS rank 10, 5 iterations; sample sizes one, two and three
thirds of the ratings (the 50k/100k/150k ratio of the original study).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinrank import ITEM, RATING, TS, USER
from kinrank.functions import metrics
from kinrank.operators import baseline, prepare
from kinrank.plans import data
from kinrank.plans.context import materialize, together
from kinrank.sources import ratings as sources

SEED = 12345
K_PRECISION = 5
K_COVERAGE = 10
N_NEIGHBORS = 20
MAX_NEIGHBORS = 100
SWEEP_MAX = 30
BUCKETS = 10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6).alias(name or (c if isinstance(c, str) else "value"))


def third_cap(spark: SparkSession, sf_dir: str, thirds: int = 1) -> int:
    """Sample size: ``thirds`` thirds of the stand-in ratings."""
    return data.ratings(spark, sf_dir).count() * thirds // 3


# ---------------------------------------------------------------- IO / PR


@query
def ratings_scan(spark, sf_dir):
    return data.ratings(spark, sf_dir)


@query
def items_scan(spark, sf_dir):
    return data.items(spark, sf_dir)


@query
def ratings_csv(spark, sf_dir):
    """IO1: the ratings as a MovieLens-style CSV, written and scanned again."""
    path = data.scratch_path(spark, "ratings-csv")
    seconds = F.unix_date(F.col(TS).cast("date")).cast("bigint") * 86400
    data.ratings(spark, sf_dir).select(
        F.col(USER).alias("userId"), F.col(ITEM).alias("movieId"), RATING, seconds.alias("timestamp"),
    ).write.mode("overwrite").option("header", True).csv(path)
    back = sources.read_ratings_csv(spark, path)
    return back.select(USER, ITEM, RATING, F.unix_seconds(TS).alias("seconds"))


@query
def items_csv(spark, sf_dir):
    """IO2: the items as a CSV, written and scanned again."""
    path = data.scratch_path(spark, "items-csv")
    data.items(spark, sf_dir).withColumnRenamed(ITEM, "movieId").write.mode("overwrite").option("header", True).csv(path)
    return sources.read_items_csv(spark, path)


@query
def sample_cap(spark, sf_dir):
    return prepare.cap_sample(data.ratings(spark, sf_dir), third_cap(spark, sf_dir))


@query
def drop_singleton_users(spark, sf_dir):
    """PR2 over every line item, orders as users."""
    rows = src.standin_line_ratings(spark, sf_dir)
    return rows.join(prepare.singleton_keys(rows, USER), USER, "left_anti")


@query
def drop_singleton_items(spark, sf_dir):
    """PR2 + PR3 over every line item, orders as items."""
    return prepare.drop_singletons(src.standin_line_ratings(spark, sf_dir, "l_partkey", "l_orderkey"))


@query
def items_with_genre(spark, sf_dir):
    return prepare.items_with_genre(data.items(spark, sf_dir)).select(ITEM, "title", "genres")


@query
def item_year(spark, sf_dir):
    return prepare.items_with_genre(data.items(spark, sf_dir)).select(ITEM, "title", "year")


@query
def clean_ratings(spark, sf_dir):
    return prepare.clean_ratings(data.ratings(spark, sf_dir), data.items(spark, sf_dir))


@query
def split_assign(spark, sf_dir):
    clean = prepare.clean_ratings(data.ratings(spark, sf_dir), data.items(spark, sf_dir))
    return prepare.assign_split(clean, SEED).select(USER, ITEM, RATING, "is_train")


@query
def train_split(spark, sf_dir):
    return data.train_test(spark, sf_dir)[0]


@query
def test_split(spark, sf_dir):
    return data.train_test(spark, sf_dir)[1]


# ---------------------------------------------------------------- baseline


def _stats(spark, sf_dir):
    train, _ = data.train_test(spark, sf_dir)
    return baseline.item_stats(train)


@query
def item_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select(ITEM, r6("avg_rating"), "review_count")


@query
def baseline_predict(spark, sf_dir):
    _, test = data.train_test(spark, sf_dir)
    return baseline.predict(test, _stats(spark, sf_dir)).select(
        ITEM, USER, RATING, r6("avg_rating"), "review_count"
    )


@query
def baseline_rmse(spark, sf_dir):
    _, test = data.train_test(spark, sf_dir)
    return baseline.rmse(baseline.predict(test, _stats(spark, sf_dir))).select(r6("rmse"))


@query
def popular_top_k(spark, sf_dir):
    return baseline.popular_top_k(_stats(spark, sf_dir), K_PRECISION).select(
        F.col("rank").cast("bigint").alias("rank"), ITEM, r6("avg_rating"), "review_count"
    )


@query
def user_truth_ranking(spark, sf_dir):
    _, test = data.train_test(spark, sf_dir)
    return baseline.user_truth_ranking(test).select(
        USER, F.col("rank").cast("bigint").alias("rank"), ITEM
    )


@query
def baseline_precision_at_k(spark, sf_dir):
    _, test = data.train_test(spark, sf_dir)
    return baseline.precision_at_k(test, _stats(spark, sf_dir), K_PRECISION).select(r6("precision"))


# ---------------------------------------------------------------- neighbourhood

from kinrank.operators import neighbors, similarity  # noqa: E402
from kinrank.sources import ratings as src  # noqa: E402


def nb_model(spark, sf_dir) -> neighbors.NeighborModel:
    """Neighbour model on the full train split, written once per session
    (means, centred ratings, top-100 table, catalogue)."""
    train, _ = data.train_test(spark, sf_dir)
    return data.memo_obj(spark, ("nb_model", sf_dir),
                         lambda: neighbors.fit(train, MAX_NEIGHBORS))


def nb_test_predictions(spark, sf_dir, n=N_NEIGHBORS, frame="test"):
    train, test = data.train_test(spark, sf_dir)
    return neighbors.predict(nb_model(spark, sf_dir), test if frame == "test" else train, n)


def _written_predictions(spark, sf_dir):
    """For metrics that read the predictions more than once."""
    return materialize(nb_test_predictions(spark, sf_dir).select(USER, ITEM, RATING, "prediction"))


@query
def user_mean(spark, sf_dir):
    train, _ = data.train_test(spark, sf_dir)
    return neighbors.user_mean(train).select(USER, r6("user_mean"))


@query
def center_ratings(spark, sf_dir):
    train, _ = data.train_test(spark, sf_dir)
    return neighbors.center(train).select(ITEM, USER, r6("rating_norm"))


@query
def user_similarity(spark, sf_dir):
    train, _ = data.train_test(spark, sf_dir)
    sim = neighbors.user_similarity(neighbors.center(train))
    return sim.select("i", "j", r6("value"))


@query
def pair_similarity(spark, sf_dir):
    """NB3 for asked pairs: every test user with the smallest train user who rated the same item."""
    train, test = data.train_test(spark, sf_dir)
    raters = train.groupBy(ITEM).agg(F.min(USER).alias("j"))
    asked = test.join(raters, ITEM).select(F.col(USER).alias("i"), "j").filter("i <> j")
    return similarity.pair_similarity(neighbors.center(train), asked).select("i", "j", r6("value"))


@query
def neighbor_predict_events(spark, sf_dir):
    """NB9 inside NB10: a model of ratings that repeat (user, item) pairs; its
    neighbours' repeated ratings are averaged.  Asked are the distinct pairs."""
    events = src.standin_rating_events(spark, sf_dir)
    model = data.memo_obj(spark, ("nb_events", sf_dir), lambda: neighbors.fit(events, MAX_NEIGHBORS))
    asked = events.select(USER, ITEM).distinct()
    return neighbors.predict(model, asked, N_NEIGHBORS).select(USER, ITEM, r6("prediction"))


@query
def top_neighbors(spark, sf_dir):
    top = nb_model(spark, sf_dir).top
    return top.select("i", "j", r6("value"), F.col("row_number").cast("bigint").alias("row_number"))


@query
def active_neighbors(spark, sf_dir):
    top = neighbors.active_neighbors(nb_model(spark, sf_dir).top, N_NEIGHBORS)
    return top.select("i", "j", r6("value"), F.col("row_number").cast("bigint").alias("row_number"))


@query
def item_index(spark, sf_dir):
    train, _ = data.train_test(spark, sf_dir)
    return neighbors.item_index(train)


@query
def gap_user_defaults(spark, sf_dir):
    train, _ = data.train_test(spark, sf_dir)
    return neighbors.gap_user_defaults(train).select("first_id", "last_id", r6("default_rating"))


@query
def dedup_ratings(spark, sf_dir):
    events = src.standin_rating_events(spark, sf_dir)
    return neighbors.dedup_ratings(events).select(USER, ITEM, r6(RATING))


@query
def neighbor_predict(spark, sf_dir):
    return nb_test_predictions(spark, sf_dir).select(USER, ITEM, RATING, r6("prediction"))


@query
def neighbor_refit(spark, sf_dir):
    """Prediction with 10 neighbours from the saved similarity, no recompute."""
    model = nb_model(spark, sf_dir)
    _, test = data.train_test(spark, sf_dir)
    return neighbors.predict(model, test, 10).select(USER, ITEM, RATING, r6("prediction"))


@query
def neighbor_predict_pairs(spark, sf_dir):
    """Single lookups for every cleaned (user, item): nulls for items the
    training catalogue lacks, 0.5 for absent users in the id range."""
    clean = prepare.clean_ratings(data.ratings(spark, sf_dir), data.items(spark, sf_dir))
    pred = neighbors.predict(nb_model(spark, sf_dir), clean.select(USER, ITEM), N_NEIGHBORS)
    return pred.select(USER, ITEM, r6("prediction"))


@query
def recommend_top_k(spark, sf_dir):
    train, _ = data.train_test(spark, sf_dir)
    recs = neighbors.recommend(nb_model(spark, sf_dir), train, N_NEIGHBORS, K_PRECISION)
    return recs.select(USER, F.col("rank").cast("bigint").alias("rank"), ITEM, r6("score"))


@query
def neighbor_rmse(spark, sf_dir):
    return metrics.rmse(nb_test_predictions(spark, sf_dir)).select(r6("rmse"))


@query
def neighbor_rmse_train(spark, sf_dir):
    return metrics.rmse(nb_test_predictions(spark, sf_dir, frame="train")).select(r6("rmse"))


@query
def rmse_by_user(spark, sf_dir):
    return metrics.rmse_by(nb_test_predictions(spark, sf_dir), USER).select(USER, r6("rmse"))


@query
def rmse_by_item(spark, sf_dir):
    return metrics.rmse_by(nb_test_predictions(spark, sf_dir), ITEM).select(ITEM, r6("rmse"))


@query
def precision_by_user(spark, sf_dir):
    prec = neighbors.precision_by_user(_written_predictions(spark, sf_dir), K_PRECISION)
    return prec.select(USER, r6("precision"))


@query
def neighbor_precision_at_k(spark, sf_dir):
    prec = neighbors.precision_by_user(_written_predictions(spark, sf_dir), K_PRECISION)
    return metrics.mean_of(prec, "precision").select(r6("precision"))


@query
def neighbor_coverage(spark, sf_dir):
    _, test = data.train_test(spark, sf_dir)
    return neighbors.coverage(nb_model(spark, sf_dir), test, N_NEIGHBORS, K_COVERAGE).select(r6("coverage"))


@query
def coverage(spark, sf_dir):
    """MT4 on the training side: neighbour top-10 of every train user."""
    train, _ = data.train_test(spark, sf_dir)
    return neighbors.coverage(nb_model(spark, sf_dir), train, N_NEIGHBORS, K_COVERAGE).select(r6("coverage"))


@query
def neighbor_sweep(spark, sf_dir):
    _, test = data.train_test(spark, sf_dir)
    out = neighbors.sweep(nb_model(spark, sf_dir), test, SWEEP_MAX, K_PRECISION)
    return out.select(F.col("n").cast("bigint").alias("n"), r6("rmse"), r6("precision"))


@query
def quantile_buckets(spark, sf_dir):
    per_user = metrics.rmse_by(nb_test_predictions(spark, sf_dir), USER)
    out = metrics.quantile_buckets(per_user, "rmse", USER, BUCKETS)
    return out.select("bucket", r6("mean_value"))


# ---------------------------------------------------------------- rankings on baseline scores

from kinrank.operators import als  # noqa: E402
from kinrank.plans import experiments  # noqa: E402
from kinrank.sources import results  # noqa: E402


def _baseline_scored(spark, sf_dir):
    _, test = data.train_test(spark, sf_dir)
    return baseline.predict(test, _stats(spark, sf_dir))


@query
def pred_rankings(spark, sf_dir):
    """AL5 on the baseline's scores: full rankings by prediction and by rating."""
    ranks = als.rankings(_baseline_scored(spark, sf_dir), pred="avg_rating")
    return ranks.select(USER, ITEM, F.col("pred_rank").cast("bigint").alias("pred_rank"),
                        F.col("truth_rank").cast("bigint").alias("truth_rank"))


@query
def rankings_top_k(spark, sf_dir):
    """MT6: both rankings cut to k (null rank = beyond k on that list)."""
    ranks = als.rankings(_baseline_scored(spark, sf_dir), pred="avg_rating", k=K_PRECISION)
    return ranks.select(USER, ITEM, F.col("pred_rank").cast("bigint").alias("pred_rank"),
                        F.col("truth_rank").cast("bigint").alias("truth_rank"))


@query
def precision_uncut(spark, sf_dir):
    """AL7 on the baseline's scores."""
    out = als.precision_uncut(_baseline_scored(spark, sf_dir), K_PRECISION, pred="avg_rating")
    return out.select(r6("precision"))


@query
def ranked_coverage(spark, sf_dir):
    """MT7: test rows joined to the user's cut (k) prediction ranking."""
    _, test = data.train_test(spark, sf_dir)
    ranks = als.rankings(_baseline_scored(spark, sf_dir), pred="avg_rating", k=K_PRECISION)
    cut = ranks.filter(F.col("pred_rank").isNotNull()).select(USER, ITEM, F.col("pred_rank").alias("rank"))
    return metrics.ranked_coverage(test, cut, K_PRECISION).select(r6("coverage"))


@query
def quantile_compare(spark, sf_dir):
    """MT9: per-user RMSE buckets of three runs side by side."""
    _, test = data.train_test(spark, sf_dir)
    runs = {
        "baseline": metrics.rmse_by(_baseline_scored(spark, sf_dir), USER, pred="avg_rating"),
        "nb5": metrics.rmse_by(neighbors.predict(nb_model(spark, sf_dir), test, 5), USER),
        "nb20": metrics.rmse_by(nb_test_predictions(spark, sf_dir), USER),
    }
    out = metrics.quantile_compare(runs, "rmse", USER, BUCKETS)
    return out.select("bucket", r6("baseline"), r6("nb5"), r6("nb20"))


# ---------------------------------------------------------------- experiments


def _sizes(spark, sf_dir):
    return [third_cap(spark, sf_dir, t) for t in (1, 2, 3)]


@query
def sample_size_sweep(spark, sf_dir):
    out = experiments.sample_size_sweep(
        data.ratings(spark, sf_dir), data.items(spark, sf_dir), _sizes(spark, sf_dir),
        n=N_NEIGHBORS, k_precision=K_PRECISION, k_coverage=K_COVERAGE,
    )
    return out.select("model", "sample_size", *[r6(c) for c in experiments.SUMMARY_COLS])


@query
def fold_mean_curve(spark, sf_dir):
    """EX4: neighbour RMSE per neighbour count, averaged over two test folds."""
    _, test = data.train_test(spark, sf_dir)
    curves = experiments.fold_curves(nb_model(spark, sf_dir), test, 2, SWEEP_MAX)
    out = experiments.fold_mean_curve(curves, "n", "rmse")
    return out.select(F.col("n").cast("bigint").alias("n"), r6("rmse"))


@query
def best_params(spark, sf_dir):
    """EX5 on the neighbour sweep: best n by RMSE and by precision."""
    _, test = data.train_test(spark, sf_dir)
    curve = neighbors.sweep(nb_model(spark, sf_dir), test, SWEEP_MAX, K_PRECISION)
    out = experiments.best_params(curve, "n", low="rmse", high="precision")
    return out.select(F.col("best_n_rmse").cast("bigint").alias("best_n_rmse"), r6("min_rmse"),
                      F.col("best_n_precision").cast("bigint").alias("best_n_precision"), r6("max_precision"))


@query
def similarity_roundtrip(spark, sf_dir):
    """IO3 + IO4: write the ranked similarity (overwrite), read it back."""
    path = data.scratch_path(spark, "similarity-sorted")
    results.write_similarity(nb_model(spark, sf_dir).top, path)
    back = results.read_similarity(spark, path)
    return back.select("i", "j", r6("value"), F.col("row_number").cast("bigint").alias("row_number"))


def study(spark, sf_dir) -> results.ResultStore:
    """Baseline and neighbour runs at three sample sizes, published once per session."""
    return data.memo_obj(spark, ("study", sf_dir), lambda: experiments.run_study(
        results.ResultStore(spark, data.scratch_path(spark, "study")),
        data.ratings(spark, sf_dir), data.items(spark, sf_dir), _sizes(spark, sf_dir),
        {"baseline": {"k": K_PRECISION},
         "neighbor": {"n": N_NEIGHBORS, "k_precision": K_PRECISION, "k_coverage": K_COVERAGE, "max_n": SWEEP_MAX}}))


@query
def run_summary(spark, sf_dir):
    """EX6 + IO5 + IO6 + EX8: neighbour runs at three sample sizes, with fit
    runtime, published by model and size, read back ordered by size."""
    cols = ["sample_size", "runtime", *experiments.SUMMARY_COLS]
    return study(spark, sf_dir).load("summary", ["neighbor"], columns=cols)


@query
def study_rmse_by_user(spark, sf_dir):
    """IO5, IO6: saved RMSE per user of two models at three sizes."""
    out = study(spark, sf_dir).load("rmse_user", columns=["model", "sample_size", USER, "rmse"])
    return out.withColumn("rmse", r6("rmse"))


@query
def study_rmse_by_item(spark, sf_dir):
    """IO5, IO6: saved RMSE per item of two models at three sizes."""
    out = study(spark, sf_dir).load("rmse_item", columns=["model", "sample_size", ITEM, "rmse"])
    return out.withColumn("rmse", r6("rmse"))


@query
def study_precision_by_user(spark, sf_dir):
    """IO5, IO6: saved precision per user of two models at three sizes."""
    out = study(spark, sf_dir).load("precision_user", columns=["model", "sample_size", USER, "precision"])
    return out.withColumn("precision", r6("precision"))


@query
def study_curve(spark, sf_dir):
    """IO5, IO6, EX1: the saved neighbour-count curves of the two larger sizes."""
    sizes = _sizes(spark, sf_dir)[1:]
    out = study(spark, sf_dir).load("curve", ["neighbor"], sizes, ["sample_size", "param", "rmse", "precision"])
    return out.select("sample_size", F.col("param").cast("bigint").alias("n"), r6("rmse"), r6("precision"))


@query
def study_best_params(spark, sf_dir):
    """EX5 on the saved curve of the middle size."""
    curve = study(spark, sf_dir).load("curve", ["neighbor"], [_sizes(spark, sf_dir)[1]])
    out = experiments.best_params(curve.withColumnRenamed("param", "n"), "n", low="rmse", high="precision")
    return out.select(F.col("best_n_rmse").cast("bigint").alias("best_n_rmse"), r6("min_rmse"),
                      F.col("best_n_precision").cast("bigint").alias("best_n_precision"), r6("max_precision"))


@query
def study_quantiles(spark, sf_dir):
    """MT9: saved RMSE by user, RMSE by item and precision by user of the
    neighbour model, bucket means of the three sizes side by side."""
    out = experiments.quantile_report(study(spark, sf_dir), "neighbor", _sizes(spark, sf_dir), BUCKETS)
    return out.select("metric", "bucket", r6("size_1"), r6("size_2"), r6("size_3"))


@query
def run_summary_metrics(spark, sf_dir):
    """EX6 with its metrics to compare and, for the seconds, whether they were recorded."""
    recorded = (F.col("runtime") > 0).alias("runtime_recorded")
    return run_summary(spark, sf_dir).select("sample_size", recorded, *[r6(c) for c in experiments.SUMMARY_COLS])


# ---------------------------------------------------------------- ALS

ALS_RANK = 10
ALS_ITER = 5
ALS_REG = 0.1
ALS_GRID = [0.05 + i * (0.3 - 0.05) / 9 for i in range(10)]  # linspace(0.05, 0.3, 10)


def _als_fit(spark, sf_dir):
    train, _ = data.train_test(spark, sf_dir)
    return data.memo_obj(spark, ("als", sf_dir),
                         lambda: als.fit(train, ALS_RANK, ALS_ITER, ALS_REG, SEED))


def _als_scored(spark, sf_dir):
    _, test = data.train_test(spark, sf_dir)
    return als.predict(_als_fit(spark, sf_dir), test)


@query
def als_predict(spark, sf_dir):
    return _als_scored(spark, sf_dir).select(USER, ITEM, RATING, r6("predicted_rating"))


@query
def als_rmse(spark, sf_dir):
    return als.rmse(_als_scored(spark, sf_dir)).select(r6("rmse"))


@query
def als_rankings(spark, sf_dir):
    ranks = als.rankings(_als_scored(spark, sf_dir))
    return ranks.select(USER, ITEM, F.col("pred_rank").cast("bigint").alias("pred_rank"),
                        F.col("truth_rank").cast("bigint").alias("truth_rank"))


@query
def als_grid_search(spark, sf_dir):
    """AL2 + AL3 + EX3: 2-fold search over the regParam curve."""
    train, _ = data.train_test(spark, sf_dir)
    return data.memo_obj(spark, ("als_grid", sf_dir), lambda: als.grid_search(
        train, [ALS_RANK], [ALS_ITER], ALS_GRID, num_folds=2, metric="rmse", parallelism=2, seed=SEED)).results


@query
def als_grid_points(spark, sf_dir):
    """AL3, EX3: the searched settings, and whether each one's error lies inside the rating range."""
    sound = ((F.col("rmse") > 0) & (F.col("rmse") < 4.5)).alias("sound")
    return als_grid_search(spark, sf_dir).select("reg_param", "rank", "max_iter", sound)


@query
def als_scored_keys(spark, sf_dir):
    """AL4: every asked pair is scored once, none without a prediction."""
    lost = F.col("predicted_rating").isNull() | F.isnan("predicted_rating")
    return _als_scored(spark, sf_dir).select(USER, ITEM, RATING, lost.alias("lost"))


@query
def als_rank_sums(spark, sf_dir):
    """AL5: truth ranks by item, and per user the sum and maximum of the predicted ranks."""
    ranks = materialize(als_rankings(spark, sf_dir))  # read twice
    sums = ranks.groupBy(USER).agg(F.sum("pred_rank").alias("pred_sum"), F.max("pred_rank").alias("pred_max"))
    return ranks.drop("pred_rank").join(sums, USER)


@query
def als_rmse_agrees(spark, sf_dir):
    """AL6 against MT1: the evaluator's RMSE and the SQL aggregate's on the same predictions."""
    scored = _als_scored(spark, sf_dir)
    own = metrics.rmse(scored, pred="predicted_rating").select("rmse").scalar()
    n = scored.agg(F.count(F.lit(1))).scalar()
    agrees = (F.abs(F.col("rmse") - own) < 1e-6).alias("agrees")
    return als.rmse(scored).select(agrees, n.alias("n"))


@query
def als_refit_equal(spark, sf_dir):
    """AL1: pairs whose prediction differs by more than 1e-4 after a second fit with the same seed."""
    train, test = data.train_test(spark, sf_dir)
    again = als.predict(als.fit(train, ALS_RANK, ALS_ITER, ALS_REG, SEED), test)
    both = _als_scored(spark, sf_dir).join(
        again.select(USER, ITEM, F.col("predicted_rating").alias("again")), [USER, ITEM])
    differs = F.abs(F.col("predicted_rating") - F.col("again")) > 1e-4
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(differs).alias("n_different"))


@query
def als_fold_table(spark, sf_dir):
    """AL2, EX3: squared error and scored rows per fold and regularisation of the search."""
    train, _ = data.train_test(spark, sf_dir)
    return data.memo_obj(spark, ("als_folds", sf_dir), lambda: als.fold_table(
        train, [ALS_RANK], [ALS_ITER], ALS_GRID, num_folds=2, seed=SEED))


@query
def als_fold_counts(spark, sf_dir):
    """AL2: the rows each fold scored per grid point."""
    return als_fold_table(spark, sf_dir).select(
        F.col("fold").cast("bigint").alias("fold"), r6("reg_param"), F.col("n").alias("n"))


@query
def als_lambda_curve(spark, sf_dir):
    """EX3, EX4: the regularisation curve per fold and its mean (null fold)."""
    table = als_fold_table(spark, sf_dir)
    curves = als.fold_curve(table).select(F.col("fold").cast("bigint").alias("fold"), "reg_param", "rmse")
    mean = als.mean_curve(table).select(F.lit(None).cast("bigint").alias("fold"), "reg_param", "rmse")
    return curves.unionByName(mean).select("fold", r6("reg_param"), r6("rmse"))


@query
def als_best_lambda(spark, sf_dir):
    """EX5: the regularisation with the lowest mean error."""
    out = experiments.best_params(als.mean_curve(als_fold_table(spark, sf_dir)), "reg_param", low="rmse")
    return out.select(r6("best_reg_param_rmse"), r6("min_rmse"))


@query
def als_curve_checks(spark, sf_dir):
    """AL3, EX3: per grid point, whether the fold table's mean is the cross-validator's
    metric, and whether the mean lies between its folds' errors.  Both evaluations run side by side."""
    data.train_test(spark, sf_dir)
    found = together(spark, {"table": lambda: als_fold_table(spark, sf_dir), "search": lambda: als_grid_search(spark, sf_dir)})
    table = found["table"]
    curve = als.mean_curve(table).withColumn("reg_param", F.round("reg_param", 2))
    folds = als.fold_curve(table).groupBy(F.round("reg_param", 2).alias("reg_param")).agg(
        F.count(F.lit(1)).alias("folds"), F.min("rmse").alias("lo"), F.max("rmse").alias("hi"))
    searched = found["search"].select("reg_param", F.col("rmse").alias("searched"))
    return curve.join(folds, "reg_param").join(searched, "reg_param").select(
        "reg_param", "folds",
        (F.abs(F.col("rmse") - F.col("searched")) < 1e-3).alias("agrees"),
        F.col("rmse").between(F.col("lo"), F.col("hi")).alias("between_folds"))


def als_study(spark, sf_dir) -> results.ResultStore:
    """Factor model runs at three sample sizes, published once per session."""
    return data.memo_obj(spark, ("als_study", sf_dir), lambda: experiments.run_study(
        results.ResultStore(spark, data.scratch_path(spark, "als-study")),
        data.ratings(spark, sf_dir), data.items(spark, sf_dir), _sizes(spark, sf_dir),
        {"als": {"reg_params": ALS_GRID, "rank": ALS_RANK, "max_iter": ALS_ITER, "num_folds": 2, "k": K_PRECISION,
                 "seed": SEED}}))


@query
def als_sample_size_sweep(spark, sf_dir):
    """EX2, ALS part: grid search, RMSE, cut precision and coverage per size."""
    return als_study(spark, sf_dir).load("summary", ["als"]).select(
        "model", "sample_size", *[r6(c) for c in experiments.SUMMARY_COLS])


@query
def als_run_summary(spark, sf_dir):
    """EX6, EX8 for the factor model, with the seconds of search and fit, ordered by size."""
    return als_study(spark, sf_dir).load(
        "summary", ["als"], columns=["sample_size", "runtime", *experiments.SUMMARY_COLS])


@query
def summary_at_size(spark, sf_dir):
    """EX7 via IO5/IO6: of the saved summaries, the neighbour model's test metrics
    at the middle sample size."""
    size = third_cap(spark, sf_dir, 2)
    back = study(spark, sf_dir).load("summary", ["neighbor"], [size], ["rmse_test", "top_k_precision_test"])
    return back.select(r6("rmse_test"), r6("top_k_precision_test"))
