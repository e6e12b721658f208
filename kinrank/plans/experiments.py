"""Experiments (EX1-EX8): sweeps, curves, best parameters, run summaries.

The loops here run over a handful of settings (sample sizes, folds), each
iteration building a distributed plan; no data passes through the driver
except one-row metrics.
"""

from __future__ import annotations

import time
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinrank import ITEM, RATING, USER
from kinrank.functions import metrics
from kinrank.functions.columns import split_hash, tie_key
from kinrank.operators import als, baseline, neighbors
from kinrank.plans.context import materialize, together
from kinrank.plans.data import nested_splits
from kinrank.sources.results import ResultStore

SUMMARY_COLS = (
    "rmse_train", "rmse_test", "top_k_precision_train", "top_k_precision_test",
    "coverage_train", "coverage_test",
)


def _one(df: DataFrame, col: str, alias: str):
    """A one-row metric frame as a scalar-subquery column."""
    return df.select(F.col(col)).scalar().alias(alias)


def _row(spark: SparkSession, parts: list) -> DataFrame:
    """One summary row whose values are scalar subqueries over the data."""
    return spark.range(1).select(*parts)


def neighbor_summary(train: DataFrame, test: DataFrame, n: int = 20, k_precision: int = 5,
                     k_coverage: int = 10, max_neighbors: int = 100) -> DataFrame:
    """Train/test RMSE, precision@k and coverage of one neighbour model (one row)."""
    return model_summary(neighbors.fit(train, max_neighbors), train, test, n, k_precision, k_coverage)


def _predicted(model: neighbors.NeighborModel, frame: DataFrame, n: int) -> DataFrame:
    return materialize(neighbors.predict(model, frame, n).select(USER, ITEM, RATING, "prediction"))


def _evaluated(model: neighbors.NeighborModel, train: DataFrame, test: DataFrame, n: int, k_coverage: int, **more):
    """Predictions of both sides, written once, the coverages, and the steps ``more``, side by side."""
    return together(train.sparkSession, {
        "train": lambda: _predicted(model, train, n),
        "test": lambda: _predicted(model, test, n),
        "covered": lambda: neighbors.coverages(model, {"train": train, "test": test}, n, k_coverage),
        **more})


def model_summary(model: neighbors.NeighborModel, train: DataFrame, test: DataFrame, n: int = 20,
                  k_precision: int = 5, k_coverage: int = 10, found: Mapping | None = None) -> DataFrame:
    """The summary row of a fitted neighbour model; its predictions are written once,
    the recommended lists made once for the users of both sides."""
    found = found or _evaluated(model, train, test, n, k_coverage)
    p_train, p_test, covered = found["train"], found["test"], found["covered"]
    return _row(train.sparkSession, [
        _one(metrics.rmse(p_train), "rmse", "rmse_train"),
        _one(metrics.rmse(p_test), "rmse", "rmse_test"),
        _one(metrics.mean_of(neighbors.precision_by_user(p_train, k_precision), "precision"),
             "precision", "top_k_precision_train"),
        _one(metrics.mean_of(neighbors.precision_by_user(p_test, k_precision), "precision"),
             "precision", "top_k_precision_test"),
        _one(covered["train"], "coverage", "coverage_train"),
        _one(covered["test"], "coverage", "coverage_test"),
    ])


def baseline_summary(train: DataFrame, test: DataFrame, k_precision: int = 5) -> DataFrame:
    """Baseline RMSE and precision@k on both sides (coverage not defined: null)."""
    stats = baseline.item_stats(train)
    return _row(train.sparkSession, [
        _one(baseline.rmse(baseline.predict(train, stats)), "rmse", "rmse_train"),
        _one(baseline.rmse(baseline.predict(test, stats)), "rmse", "rmse_test"),
        _one(baseline.precision_at_k(train, stats, k_precision), "precision", "top_k_precision_train"),
        _one(baseline.precision_at_k(test, stats, k_precision), "precision", "top_k_precision_test"),
    ]).select("*", F.lit(None).cast("double").alias("coverage_train"),
              F.lit(None).cast("double").alias("coverage_test"))


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def sample_size_sweep(ratings: DataFrame, items: DataFrame, sizes: list[int],
                      models=("baseline", "neighbor"), n: int = 20, k_precision: int = 5,
                      k_coverage: int = 10) -> DataFrame:
    """EX2 (without runtime): one row per (model, sample size), all sizes from one numbering."""
    rows = []
    for size, (train, test) in nested_splits(ratings, items, sizes).items():
        for m in models:
            if m == "baseline":
                r = baseline_summary(train, test, k_precision)
            else:
                r = neighbor_summary(train, test, n, k_precision, k_coverage)
            rows.append(r.select(F.lit(m).alias("model"), F.lit(size).cast("bigint").alias("sample_size"),
                                 *SUMMARY_COLS))
    return _stacked(rows)


def _timed(build):
    start = time.perf_counter()
    built = build()
    return built, time.perf_counter() - start


def _curve(rows: DataFrame, param: str) -> DataFrame:
    precision = F.col("precision") if "precision" in rows.columns else F.lit(None).cast("double")
    return rows.select(F.col(param).cast("double").alias("param"), "rmse", precision.alias("precision"))


def baseline_results(train: DataFrame, test: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    """The result kinds of the item-mean model (it has no curve)."""
    stats, runtime = _timed(lambda: materialize(baseline.item_stats(train)))
    scored = materialize(baseline.predict(test, stats).select(USER, ITEM, RATING, F.col("avg_rating").alias("prediction")))
    return {
        "rmse_user": metrics.rmse_by(scored, USER),
        "rmse_item": metrics.rmse_by(scored, ITEM),
        "precision_user": baseline.precision_by_user(test, stats, k).select(USER, "precision"),
        "summary": baseline_summary(train, test, k).withColumn("runtime", F.lit(float(runtime))),
    }


def neighbor_results(train: DataFrame, test: DataFrame, n: int = 20, k_precision: int = 5, k_coverage: int = 10,
                     max_n: int = 30) -> dict[str, DataFrame]:
    """The five result kinds of the neighbour model; the curve is the sweep over 1..max_n neighbours."""
    model, runtime = _timed(lambda: neighbors.fit(train))
    # After the fit, whose seconds are recorded, nothing is timed.
    found = _evaluated(model, train, test, n, k_coverage,
                       curve=lambda: neighbors.sweep(model, test, max_n, k_precision))
    scored = found["test"]
    return {
        "rmse_user": metrics.rmse_by(scored, USER),
        "rmse_item": metrics.rmse_by(scored, ITEM),
        "precision_user": neighbors.precision_by_user(scored, k_precision),
        "curve": _curve(found["curve"], "n"),
        "summary": model_summary(model, train, test, n, k_precision, k_coverage, found)
        .withColumn("runtime", F.lit(float(runtime))),
    }


def als_results(train: DataFrame, test: DataFrame, reg_params, rank: int = 10, max_iter: int = 5,
                num_folds: int = 2, k: int = 5, seed: int = 12345) -> dict[str, DataFrame]:
    """The five result kinds of the factor model: a fold evaluation over the
    regularisation grid (the curve is its mean over the folds, the runtime that of
    the search and the fit at its best point), then, on both sides, RMSE,
    precision@k of the cut rankings (MT6 + MT3) and coverage of the cut
    predicted lists joined to the frame (MT7).  Predictions are written once."""
    fitted, runtime = _timed(lambda: als.fit_best(
        train, als.fold_table(train, [rank], [max_iter], reg_params, num_folds, seed=seed), seed))

    def evaluated(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
        scored = materialize(als.predict(fitted, frame).select(USER, ITEM, RATING, "predicted_rating"))
        return scored, materialize(als.rankings(scored, k=k))

    found = together(train.sparkSession, {"train": lambda: evaluated(train), "test": lambda: evaluated(test)})
    parts, kinds = [], {"curve": _curve(fitted.results, "reg_param")}
    for side, frame in (("train", train), ("test", test)):
        scored, cut = found[side]
        truth = cut.filter(F.col("truth_rank").isNotNull()).select(USER, ITEM)
        guess = cut.filter(F.col("pred_rank").isNotNull()).select(USER, ITEM, F.col("pred_rank").alias("rank"))
        precision = metrics.list_precision(truth, guess, k)
        parts += [
            _one(metrics.rmse(scored, pred="predicted_rating"), "rmse", f"rmse_{side}"),
            _one(metrics.mean_of(precision, "precision"), "precision", f"top_k_precision_{side}"),
            _one(metrics.ranked_coverage(frame, guess, k), "coverage", f"coverage_{side}"),
        ]
        if side == "test":
            kinds |= {
                "rmse_user": metrics.rmse_by(scored, USER, pred="predicted_rating"),
                "rmse_item": metrics.rmse_by(scored, ITEM, pred="predicted_rating"),
                "precision_user": precision,
            }
    summary = _row(train.sparkSession, parts).select(*SUMMARY_COLS, F.lit(float(runtime)).alias("runtime"))
    return kinds | {"summary": summary}


STUDIES = {"baseline": baseline_results, "neighbor": neighbor_results, "als": als_results}


def run_study(store: ResultStore, ratings: DataFrame, items: DataFrame, sizes: list[int],
              settings: Mapping[str, Mapping]) -> ResultStore:
    """EX2, EX6, IO5: fit, evaluate and publish every model of ``settings`` (name ->
    arguments of its ``*_results``) at every sample size, all from one numbering."""
    for size, (train, test) in nested_splits(ratings, items, sizes).items():
        for model, arguments in settings.items():
            store.publish(model, size, STUDIES[model](train, test, **arguments))
    return store


def quantile_report(store: ResultStore, model: str, sizes: list[int], q: int = 10) -> DataFrame:
    """MT9 over saved results: for the three per-key metrics, the bucket means of the
    sample sizes side by side: ``(metric, bucket, size_1, size_2, ...)``, smallest size first."""
    parts = []
    for kind, key, value in (("rmse_user", USER, "rmse"), ("rmse_item", ITEM, "rmse"),
                             ("precision_user", USER, "precision")):
        runs = {f"size_{i}": store.load(kind, [model], [size]) for i, size in enumerate(sorted(sizes), 1)}
        parts.append(metrics.quantile_compare(runs, value, key, q).withColumn("metric", F.lit(kind)))
    return _stacked(parts)


def fold_curves(model: neighbors.NeighborModel, frame: DataFrame, folds: int, max_n: int,
                seed: int = 12345) -> DataFrame:
    """Neighbour RMSE curve 1..max_n on each hash fold of ``frame``:
    ``(fold, n, rmse)`` -- the per-part curves EX4 averages.  One pass:
    the fold is just another grouping key."""
    keyed = frame.select(USER, ITEM, RATING).withColumn(
        "fold", (split_hash(USER, ITEM, seed + 2) % folds).cast("bigint")
    )
    return neighbors.error_curve(model, keyed, max_n, ["fold"])


def fold_mean_curve(curves: DataFrame, param: str, metric: str) -> DataFrame:
    """EX4: the curve averaged over its parts: ``(param, metric)``."""
    return curves.groupBy(param).agg(F.avg(metric).alias(metric))


def best_params(curve: DataFrame, param: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """EX5: argmin of ``low`` and argmax of ``high``; ties go to the smaller
    parameter.  One aggregate row: ``best_<param>_<low>``, ``min_<low>``,
    ``best_<param>_<high>``, ``max_<high>``."""
    aggs = []
    if low:
        m = F.min(F.struct(tie_key(low).alias("v"), F.col(param).alias("p"), F.col(low).alias("raw")))
        aggs += [m.getField("p").alias(f"best_{param}_{low}"), m.getField("raw").alias(f"min_{low}")]
    if high:
        m = F.max(F.struct(tie_key(high).alias("v"), (-F.col(param)).alias("p"), F.col(high).alias("raw")))
        aggs += [(-m.getField("p")).alias(f"best_{param}_{high}"), m.getField("raw").alias(f"max_{high}")]
    return curve.agg(*aggs)
