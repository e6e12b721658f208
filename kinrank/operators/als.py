"""ALS matrix factorisation (AL1-AL7) on Spark ML's distributed ALS.

Differences from a plain ``ALS().fit``:

* ids are checked against the 32-bit range ALS needs; out-of-range ids
  are replaced by a dense index (numbered without a single-task window)
  and mapped back after prediction;
* cross-validation folds come from a row hash (``foldCol``), not from a
  random column, so a fold never changes when a partition is recomputed;
* per-grid-point results are returned as a DataFrame, fresh per call;
* a fit checkpoints every other iteration, which removes the factors sent before,
  and models score by hash joins with their factor tables (``score``).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinrank import ITEM, RATING, USER
from kinrank.functions.columns import split_hash, tie_key
from kinrank.functions.joins import ROWS_PER_TASK
from kinrank.functions.ranking import global_row_number, group_row_number, top_k_per_group
from kinrank.operators.prepare import drop_time
from kinrank.plans.context import discard, materialize, partition_count, reclaim

#: Ratings of one block of the factorisation, and the least number of blocks asked for.
BLOCK_RATINGS = 10_000_000
MIN_BLOCKS = 10
#: Ratings above which models score by hash joins.
HASHED_RATINGS = 4_000_000
INT_MAX = 2**31 - 1
INT_MIN = -(2**31)


class IdCodec(NamedTuple):
    """How ids reach ALS: ``None`` maps mean a plain cast to int."""

    users: DataFrame | None
    items: DataFrame | None


def _index(df: DataFrame, key: str) -> DataFrame:
    ids = df.select(key).distinct()
    return global_row_number(ids, [F.col(key)], name="_idx").select(
        key, (F.col("_idx") - 1).cast("int").alias(f"_{key}_int")
    )


def id_codec(train: DataFrame) -> IdCodec:
    """AL1 guard: cast when ids fit 32 bits, else a dense index per key."""
    r = train.agg(
        F.min(USER).alias("umin"), F.max(USER).alias("umax"),
        F.min(ITEM).alias("imin"), F.max(ITEM).alias("imax"),
    ).first()
    fits = lambda lo, hi: lo is None or (lo >= INT_MIN and hi <= INT_MAX)
    return IdCodec(
        None if fits(r["umin"], r["umax"]) else _index(train, USER),
        None if fits(r["imin"], r["imax"]) else _index(train, ITEM),
    )


def encode(df: DataFrame, codec: IdCodec) -> DataFrame:
    out = df
    for key, mapping in ((USER, codec.users), (ITEM, codec.items)):
        if mapping is None:
            out = out.withColumn(f"_{key}_int", F.col(key).try_cast("int"))
        else:
            # Unknown ids get a null code; ``predict`` drops them as cold starts.
            out = out.join(mapping, key, "left")
    return out


def score(model: ALSModel, coded: DataFrame, hashed: bool = True) -> DataFrame:
    """``coded`` with ``prediction``, the product of the two ids' factors; rows without both are dropped.

    The values of ``ALSModel.transform``, whose joins sort the rows twice per model as soon as
    the factors are too large to be broadcast.  ``hashed``: the factor tables, one row an id, are
    hashed where their ids lie, and the rows, many times as many, pass by unsorted.
    """
    out = coded
    for factors, key, name in ((model.userFactors, model.getUserCol(), "_u"), (model.itemFactors, model.getItemCol(), "_v")):
        table = factors.select(F.col("id").alias(key), F.col("features").alias(name))
        out = out.join(table.hint("shuffle_hash") if hashed else table, key)
    # Added up one by one, as floats: the order and precision of the model's own dot product.
    dot = reduce(lambda x, y: x + y, [F.get("_u", F.lit(i)) * F.get("_v", F.lit(i)) for i in range(model.rank)])
    scored = out.select(*coded.columns, dot.alias(model.getPredictionCol()))
    return scored.filter(~F.isnan(model.getPredictionCol()))


class FactorModel(ALSModel):
    """A fitted model that scores through ``score``."""

    hashed = True

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return score(self, dataset, self.hashed)


class FactorEstimator(ALS):
    """``ALS`` that gives ``FactorModel`` and first gives back the disk of fits that are no longer used."""

    hashed = True

    def _fit(self, dataset: DataFrame) -> FactorModel:
        reclaim(dataset.sparkSession)
        return super()._fit(dataset)

    def _create_model(self, java_model) -> FactorModel:
        model = FactorModel(java_model)
        model.hashed = self.hashed
        return model


def estimator(rank: int = 10, max_iter: int = 5, reg_param: float = 0.1, seed: int = 12345,
              blocks: int = 10, hashed: bool = True) -> FactorEstimator:
    """AL1: explicit-feedback ALS dropping cold-start rows, in ``blocks`` user and item blocks.

    The factors sent between blocks stay on disk until a checkpoint: with one every other
    iteration, a fit holds two iterations of them, not all."""
    als = FactorEstimator(
        userCol=f"_{USER}_int", itemCol=f"_{ITEM}_int", ratingCol=RATING,
        coldStartStrategy="drop",
        rank=rank, maxIter=max_iter, regParam=reg_param, seed=seed,
        numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=2,
    )
    als.hashed = hashed
    return als


def block_count(ratings: int, partitions: int) -> int:
    """Blocks by the number of ratings.  A half step writes a piece for every pair of
    blocks and sends a factor to each block that rates it, so more blocks than the
    data asks for are paid in every step."""
    return max(1, min(partitions, max(MIN_BLOCKS, -(-ratings // BLOCK_RATINGS))))


def _sizes(train: DataFrame) -> tuple[int, bool]:
    """(blocks of a fit, whether its models score by hash joins): small factors are left to be broadcast."""
    ratings = train.count()
    return block_count(ratings, partition_count(train.sparkSession)), ratings > HASHED_RATINGS


class AlsFit(NamedTuple):
    model: object  # ALSModel
    codec: IdCodec
    results: DataFrame | None = None


def fit(train: DataFrame, rank: int = 10, max_iter: int = 5, reg_param: float = 0.1,
        seed: int = 12345) -> AlsFit:
    train = drop_time(train)
    codec = id_codec(train)
    model = estimator(rank, max_iter, reg_param, seed, *_sizes(train)).fit(encode(train, codec))
    return AlsFit(model, codec)


def grid_search(
    train: DataFrame, ranks=(10,), max_iters=(5,), reg_params=(0.1,), num_folds: int = 2,
    metric: str = "rmse", parallelism: int = 2, seed: int = 12345, collect_sub_models: bool = False,
) -> AlsFit:
    """AL2 + AL3: k-fold grid search; ``results`` has one row per grid point
    with the mean fold metric (4 decimals) and the parameters (2 decimals).

    Sub-models are not kept by default: each holds its factor tables and
    nothing downstream reads them.
    """
    train = drop_time(train)
    codec = id_codec(train)
    blocks, hashed = _sizes(train)
    als = estimator(seed=seed, blocks=blocks, hashed=hashed)
    grid = (
        ParamGridBuilder()
        .addGrid(als.rank, list(ranks))
        .addGrid(als.maxIter, list(max_iters))
        .addGrid(als.regParam, [float(x) for x in reg_params])
        .build()
    )
    evaluator = RegressionEvaluator(metricName=metric, labelCol=RATING, predictionCol="prediction")
    data = encode(train, codec).withColumn(
        "_fold", (split_hash(USER, ITEM, seed + 1) % num_folds).cast("int")
    )
    cv = CrossValidator(
        estimator=als, estimatorParamMaps=grid, evaluator=evaluator, numFolds=num_folds,
        foldCol="_fold", parallelism=parallelism, collectSubModels=collect_sub_models, seed=seed,
    )
    cv_model: CrossValidatorModel = cv.fit(data)
    rows = [
        (round(float(m), 4), *(round(float(pm[p]), 2) for p in (als.rank, als.maxIter, als.regParam)))
        for m, pm in zip(cv_model.avgMetrics, cv_model.getEstimatorParamMaps())
    ]
    # One row per grid point: bounded by the grid, built on the driver.
    results = train.sparkSession.createDataFrame(
        rows, f"{metric} double, rank double, max_iter double, reg_param double"
    )
    return AlsFit(cv_model.bestModel, codec, results)


FOLD_TABLE = "fold int, rank int, max_iter int, reg_param double, squared_error double, n bigint"


def fold_table(
    train: DataFrame, ranks=(10,), max_iters=(5,), reg_params=(0.1,), num_folds: int = 2,
    parallelism: int = 2, seed: int = 12345, predictions: str | None = None,
) -> DataFrame:
    """AL2 + AL3 as an evaluation table: one row per fold and grid point with the
    sum of squared errors and the number of scored rows of the held-out fold.

    Folds are those of ``grid_search`` (a hash of the row).  Each error is a
    partial aggregate of the fold's predictions; fold curves, their means and the
    best point are SQL over this table (``fold_curve``, ``mean_curve``), where a
    cross-validator keeps only one mean per point.  The fold's rows are written
    once and read by all its fits.  ``predictions``: a folder that
    also gets every scored row, partitioned by fold and grid point.
    """
    from itertools import product

    train = drop_time(train)
    codec = id_codec(train)
    sizes = _sizes(train)
    fold = (split_hash(USER, ITEM, seed + 1) % num_folds).cast("int")
    coded = materialize(encode(train, codec).withColumn("_fold", fold), by=["_fold"])

    def evaluate(job: tuple) -> tuple:
        held_out, rank, max_iter, reg = job
        model = estimator(rank, max_iter, reg, seed, *sizes).fit(coded.filter(F.col("_fold") != held_out))
        scored = model.transform(coded.filter(F.col("_fold") == held_out))
        if predictions:
            point = f"fold={held_out}/rank={rank}/max_iter={max_iter}/reg_param={reg}"
            path = f"{predictions.rstrip('/')}/{point}"
            scored.select(USER, ITEM, RATING, "prediction").write.mode("overwrite").parquet(path)
            scored = train.sparkSession.read.parquet(path)
        error = F.pow(F.col(RATING) - F.col("prediction"), 2)
        row = scored.agg(F.sum(error).alias("squared_error"), F.count(F.lit(1)).alias("n")).first()
        del model, scored
        reclaim(train.sparkSession)
        return (held_out, rank, max_iter, float(reg), row.squared_error, row.n)

    jobs = list(product(range(num_folds), ranks, max_iters, reg_params))
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        rows = list(pool.map(inheritable_thread_target(train.sparkSession)(evaluate), jobs))
    discard(coded)
    # One row per fold and grid point: bounded by the grid.
    return train.sparkSession.createDataFrame(rows, FOLD_TABLE)


POINT = ("rank", "max_iter", "reg_param")


def fold_curve(table: DataFrame) -> DataFrame:
    """EX3: ``(fold, rank, max_iter, reg_param, n, rmse)``, null where a fold scored no row."""
    return table.select("fold", *POINT, "n", F.sqrt(F.col("squared_error") / F.nullif("n", F.lit(0))).alias("rmse"))


def mean_curve(table: DataFrame) -> DataFrame:
    """EX4 for the factor model: the fold curves' mean per grid point, ``(rank, max_iter, reg_param, rmse)``."""
    return fold_curve(table).groupBy(*POINT).agg(F.avg("rmse").alias("rmse"))


def fit_best(train: DataFrame, table: DataFrame, seed: int = 12345) -> AlsFit:
    """EX5: a fit on all of ``train`` at the grid point with the lowest mean error (ties:
    the smaller rank, iterations and regularisation)."""
    best = mean_curve(table).orderBy(tie_key("rmse"), *POINT).first()
    fitted = fit(train, best.rank, best.max_iter, best.reg_param, seed)
    return fitted._replace(results=mean_curve(table))


def predict(fitted: AlsFit, frame: DataFrame) -> DataFrame:
    """AL4: ``frame`` + ``predicted_rating``; cold-start rows dropped."""
    coded = encode(drop_time(frame), fitted.codec).dropna(subset=[f"_{USER}_int", f"_{ITEM}_int"])
    scored = fitted.model.transform(coded)
    return scored.drop(f"_{USER}_int", f"_{ITEM}_int").withColumnRenamed("prediction", "predicted_rating")


PRED_ORDER = lambda pred: (tie_key(pred).desc(), F.col(ITEM).desc())
def truth_order():
    return (F.col(RATING).desc(), F.col(ITEM).desc())


def rankings(scored: DataFrame, pred: str = "predicted_rating", k: int | None = None) -> DataFrame:
    """AL5: per user, ranks of the user's own scored items by prediction
    (desc, id desc) and by rating (desc, id desc); long form
    ``(user_id, item_id, pred_rank, truth_rank)``.

    With ``k`` (MT6) only items in either top-k survive, the other rank
    being null when beyond k; without ``k`` both full rankings.  The scored rows
    are then written once and cross one shuffle, to where their user's two orders are
    numbered.  Where a user has more than ``ROWS_PER_TASK`` rows, all are numbered
    without a per-user task: by rating, and that numbered table, which carries the
    truth rank, once more by prediction.
    """
    rows = scored.select(USER, ITEM, RATING, pred)
    if k is None:
        rows = materialize(rows.filter(F.col(USER).isNotNull()))
        longest = rows.groupBy(USER).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("_n")).first()["_n"] or 0
        if longest <= ROWS_PER_TASK:
            by_truth = top_k_per_group(rows, [USER], truth_order(), None, name="truth_rank")
            both = top_k_per_group(by_truth, [USER], PRED_ORDER(pred), None, name="pred_rank")
            return both.select(USER, ITEM, "pred_rank", "truth_rank")
        by_truth = group_row_number(rows, [USER], truth_order(), name="truth_rank")
        both = group_row_number(by_truth, [USER], PRED_ORDER(pred), name="pred_rank")
        return both.select(USER, ITEM, "pred_rank", "truth_rank")
    by_pred = top_k_per_group(rows, [USER], PRED_ORDER(pred), k, name="pred_rank")
    by_truth = top_k_per_group(rows, [USER], truth_order(), k, name="truth_rank")
    return by_pred.select(USER, ITEM, "pred_rank").join(
        by_truth.select(USER, ITEM, "truth_rank"), [USER, ITEM], "full"
    )


def precision_uncut(scored: DataFrame, k: int, pred: str = "predicted_rating") -> DataFrame:
    """AL7: mean over users of |first k predicted ∩ all the user's items| / k.

    Both lists hold the same items, so this is mean(min(k, n_u) / k) for any
    model; kept for parity, the cut form (MT3 on MT6) is the useful one.
    """
    top = top_k_per_group(scored.select(USER, ITEM, pred), [USER], PRED_ORDER(pred), k)
    hits = top.join(scored.select(USER, ITEM), [USER, ITEM], "left_semi").groupBy(USER).agg(
        F.count(F.lit(1)).alias("_h")
    )
    users = scored.select(USER).distinct()
    per_user = users.join(hits, USER, "left").select(
        (F.coalesce(F.col("_h"), F.lit(0)) / F.lit(float(k))).alias("precision")
    )
    return per_user.agg(F.avg("precision").alias("precision"))


def rmse(scored: DataFrame, metric: str = "rmse", pred: str = "predicted_rating") -> DataFrame:
    """AL6: the evaluator's metric as a one-row frame (an aggregate job)."""
    ev = RegressionEvaluator(metricName=metric, labelCol=RATING, predictionCol=pred)
    value = ev.evaluate(scored)
    return scored.sparkSession.createDataFrame([(float(value),)], f"{metric} double")
