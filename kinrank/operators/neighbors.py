"""User-neighbourhood recommender on mean-centred cosine similarity (NB1-NB16).

Model (all long-form DataFrames, nothing dense, nothing on the driver):

* ``means``    (user_id, user_mean)
* ``centered`` (item_id, user_id, rating_norm)   rating - user mean
* ``rated``    (_v, item_id, _x)                 the same, one row per (user,
  item): duplicates averaged (NB9)
* ``top``      (i, j, value, row_number)         up to ``max_neighbors``
  most similar j per i, i < j (upper triangle, as a column-similarity
  matrix reports it) unless ``symmetric``.

Similarity is the exact cosine of two users' centred rating vectors; the
norms run over *all* of a user's ratings, and a pair exists only when the
users share an item on which both centred ratings are non-zero.

Prediction for (u, m) with the first ``n`` neighbours of u:
``mean_u + sum_v sim(u, v) * rating_norm(v, m)`` -- no division by the sum
of similarities and no clipping; neighbours that did not rate m add 0;
users with no neighbour get their mean.  Items absent from the training
catalogue get a null prediction.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinrank import ITEM, RATING, USER
from kinrank.functions import metrics
from kinrank.functions.columns import TIE_DIGITS, tie_key
from kinrank.functions.joins import ROWS_PER_TASK, loads_of, measure, split_join, tasks_for
from kinrank.functions.ranking import global_row_number, top_k_per_group
from kinrank.operators.similarity import PAIR_RATERS, blocked_top_neighbors, pair_load, pair_sums
from kinrank.plans.context import materialize, materialize_bucketed, partition_count

# Default value the padded (absent) users of 1..max user id receive.
GAP_USER_RATING = 0.5
# Ratings of one packed row of a neighbour.
PACK = 1_000


class NeighborModel(NamedTuple):
    means: DataFrame
    centered: DataFrame
    top: DataFrame
    catalogue: DataFrame
    rated: DataFrame | None = None


def user_mean(train: DataFrame) -> DataFrame:
    """NB1: ``(user_id, user_mean)``."""
    return train.groupBy(USER).agg(F.avg(RATING).alias("user_mean"))


def center(train: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """NB2: ``(item_id, user_id, rating_norm)`` = rating - user mean.

    A join with the (partially aggregated) means rather than a window
    average, so a heavy user is split by AQE's skew handling instead of
    landing in one window task.
    """
    means = means if means is not None else user_mean(train)
    return train.join(means, USER, "left").select(
        ITEM, USER, (F.col(RATING) - F.col("user_mean")).alias("rating_norm")
    )


def user_similarity(centered: DataFrame, salt_buckets: int | str = "auto",
                    hot_raters: int = 20_000) -> DataFrame:
    """NB3: exact cosine similarity of user pairs, ``(i, j, value)``, i < j.

    Vectors are normalised first (norm over all of a user's centred
    ratings), zeros dropped, then a self-join on item with ``a.user <
    b.user`` and a sum per pair (partially aggregated before the shuffle).
    The output is by definition every co-rating pair; what must not
    happen is one task owning a popular item's c^2 products.

    Salting: an item with c raters is split into s = ceil(c / hot_raters)
    blocks of raters (by user hash); each side is replicated over the
    other side's s blocks and the join key is (item, block_a, block_b), so
    the item's products are computed by s^2 tasks of (c/s)^2 each.  Items
    below ``hot_raters`` keep s = 1 (no replication).  ``salt_buckets``:
    "auto" (per item, as above), an int (same s for every item; 1 = off).
    The joins shuffle as the planner sees fit, so AQE can still split what is skewed.

    With "auto", and no item of more than ``PAIR_RATERS`` raters, the pairs are dealt
    out packed by their first user instead (``similarity.pair_sums``): a task then
    adds up a bounded number of pairs, where the join's tasks fill their memory.
    """
    if salt_buckets == "auto":
        load = pair_load(centered)
        if load.most <= min(hot_raters, PAIR_RATERS):
            return pair_sums(centered, load)
    norms = centered.groupBy(USER).agg(
        F.sqrt(F.sum(F.col("rating_norm") * F.col("rating_norm"))).alias("_norm")
    )
    nz = (
        centered.filter(F.col("rating_norm") != 0)
        .join(norms, USER)
        .select(ITEM, USER, (F.col("rating_norm") / F.col("_norm")).alias("_x"))
    )
    if salt_buckets == 1:
        a = nz.select(ITEM, F.col(USER).alias("i"), F.col("_x").alias("_xa"))
        b = nz.select(ITEM, F.col(USER).alias("j"), F.col("_x").alias("_xb"))
        pairs = a.join(b, ITEM).filter(F.col("i") < F.col("j"))
    else:
        if salt_buckets == "auto":
            raters = nz.groupBy(ITEM).agg(F.count(F.lit(1)).alias("_c"))
            blocks = raters.select(
                ITEM, F.greatest(F.lit(1), F.ceil(F.col("_c") / F.lit(hot_raters))).cast("int").alias("_s")
            )
            nz = nz.join(blocks, ITEM)
        else:
            nz = nz.withColumn("_s", F.lit(int(salt_buckets)))
        own = F.pmod(F.xxhash64(USER), F.col("_s")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("_s") - 1))
        a = nz.select(ITEM, F.col(USER).alias("i"), F.col("_x").alias("_xa"),
                      own.alias("_sa"), other.alias("_sb"))
        b = nz.select(ITEM, F.col(USER).alias("j"), F.col("_x").alias("_xb"),
                      other.alias("_sa"), own.alias("_sb"))
        keys = [ITEM, "_sa", "_sb"]
        pairs = a.join(b, keys).filter(F.col("i") < F.col("j"))
    return pairs.groupBy("i", "j").agg(F.sum(F.col("_xa") * F.col("_xb")).alias("value"))


def top_neighbors(sim: DataFrame, max_neighbors: int = 100, symmetric: bool = False) -> DataFrame:
    """NB4: the ``max_neighbors`` most similar j per i, numbered from 1.

    Ties on the (rounded) value go to the smaller j.  With
    ``symmetric=True`` each pair also counts for j (union with i/j
    swapped); the default keeps the upper triangle only.
    """
    if symmetric:
        sim = sim.unionByName(sim.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    ranked = top_k_per_group(
        sim, ["i"], [tie_key("value").desc(), F.col("j")], max_neighbors, name="row_number"
    )
    return ranked.select("i", "j", "value", F.col("row_number").cast("int"))


def fit(train: DataFrame, max_neighbors: int = 100, symmetric: bool = False,
        blocks: int | None = None) -> NeighborModel:
    """NB1-NB4, NB9: the model as written tables, so that every use starts from files.

    The neighbour lists come from pairs of user blocks, without a pair table
    (``operators.similarity``).  ``top`` and ``rated`` are bucketed and sorted by
    the user they are looked up by: predictions with another neighbour count, or
    of another frame, join them without shuffling them again.
    """
    means = materialize(user_mean(train))
    centered = materialize(center(train, means))
    buckets = partition_count(train.sparkSession, centered.count())
    top = materialize_bucketed(blocked_top_neighbors(centered, max_neighbors, symmetric, blocks), "i", buckets)
    rated = materialize_bucketed(neighbor_ratings(centered), "_v", buckets)
    return NeighborModel(means, centered, top, catalogue_of(train), rated)


def catalogue_of(train: DataFrame) -> DataFrame:
    """``(item_id, _d)``: the items of ``train``, numbered by id from the largest."""
    return materialize(global_row_number(train.select(ITEM).distinct(), [F.col(ITEM).desc()], name="_d"))


def _positions(model: NeighborModel) -> DataFrame:
    """The numbered catalogue, also of a model put together without the numbers."""
    return model.catalogue if "_d" in model.catalogue.columns else catalogue_of(model.catalogue)


#: The name under which the written fit was known.
fit_materialized = fit


def with_top(model: NeighborModel, top: DataFrame) -> NeighborModel:
    """NB11: the same model over a saved / reloaded similarity table."""
    return model._replace(top=top)


def active_neighbors(top: DataFrame, n: int) -> DataFrame:
    """NB5: the first ``n`` neighbours of each user (fewer if fewer exist)."""
    return top.filter(F.col("row_number") <= n)


def item_index(train: DataFrame) -> DataFrame:
    """NB6: distinct items in id order with a 0-based dense index."""
    items = train.select(ITEM).distinct()
    return global_row_number(items, [F.col(ITEM)], name="_rn").select(
        ITEM, (F.col("_rn") - 1).alias("item_index")
    )


def gap_user_defaults(train: DataFrame) -> DataFrame:
    """NB7: ranges of user ids in 1..max(user) with no rating, and their default.

    A dense user x item matrix needs every id in 1..max; an absent user
    was padded with one 0.5 rating, so its prediction is 0.5 everywhere
    (``predict`` answers that).  Here the gaps between neighbouring ids are
    listed, (first_id, last_id, default_rating), never the ids themselves.
    """
    ids = train.select(USER).filter(F.col(USER) >= 1).distinct()
    numbered = global_row_number(ids, [F.col(USER)], name="_rn")
    before = numbered.select((F.col("_rn") + 1).alias("_rn"), F.col(USER).alias("_before"))
    first = F.coalesce("_before", F.lit(0)) + 1
    gaps = numbered.join(before, "_rn", "left").filter(first < F.col(USER))
    return gaps.select(
        first.alias("first_id"), (F.col(USER) - 1).alias("last_id"), F.lit(GAP_USER_RATING).alias("default_rating"))


def dedup_ratings(ratings: DataFrame) -> DataFrame:
    """NB9: one row per (user, item), duplicates averaged (a pivot's mean)."""
    return ratings.groupBy(USER, ITEM).agg(F.avg(RATING).alias(RATING))


def neighbor_ratings(centered: DataFrame) -> DataFrame:
    """``(_v, item_id, _x)``: centred ratings of the prediction side, duplicates of a (user, item) averaged."""
    return centered.groupBy(F.col(USER).alias("_v"), ITEM).agg(F.avg("rating_norm").alias("_x"))


def _rated(model: NeighborModel) -> DataFrame:
    return neighbor_ratings(model.centered) if model.rated is None else model.rated


def _active(model: NeighborModel, n: int) -> DataFrame:
    return active_neighbors(model.top, n).select(
        F.col("i").alias(USER), F.col("j").alias("_v"), F.col("value").alias("_sim"), F.col("row_number").alias("_r"))


def _contributions(model: NeighborModel, keys: DataFrame, n: int) -> DataFrame:
    """``(user_id, item_id, _r, _c)``: what each of the first ``n`` neighbours adds
    to the asked pairs ``keys`` (distinct).

    A user's asked items travel packed, once per neighbour, to the neighbour's packed
    ratings; only the items both have become rows, so asked pairs times neighbours are
    never rows.  A hub, a user that very many others have as neighbour, is split by the
    packs that come for it.
    """
    active = _active(model, n)
    asks = keys.groupBy(USER).agg(F.count(F.lit(1)).alias("_l"))
    degrees = active.groupBy(USER).agg(F.count(F.lit(1)).alias("_r"))
    own = loads_of(asks.join(degrees.hint("merge"), USER), USER)
    # The hints here and below keep tables that grow with the data from being broadcast by the driver.
    asked = _asked_packs(keys, _parts(model)).join(active.hint("merge"), USER)
    hubs = own._replace(hot=None)
    if own.total > ROWS_PER_TASK:
        wanted = active.join(asks.hint("merge"), USER).groupBy("_v").agg(F.sum("_l").alias("_l")).withColumn("_r", F.lit(1))
        hubs = loads_of(wanted, "_v")
    both = split_join(asked, _rated_packs(_rated(model)), ["_v"], "_v", hubs)
    common = both.select(USER, "_r", "_sim", "_has", "_xs", F.explode(F.array_intersect("_asks", "_has")).alias(ITEM))
    x = F.get("_xs", (F.array_position("_has", F.col(ITEM)) - 1).cast("int"))
    return common.select(USER, ITEM, "_r", (F.col("_sim") * x).alias("_c"))


def _parts(model: NeighborModel) -> int:
    """The buckets of a fitted model's tables; sides dealt out alike join them as they lie."""
    return partition_count(model.centered.sparkSession, model.centered.count())


def _asked_packs(keys: DataFrame, parts: int | None = None) -> DataFrame:
    """``(user_id, _asks)``: a user's asked items in arrays of at most ``PACK``."""
    rows = keys.filter(F.col(ITEM).isNotNull()).repartition(parts or partition_count(keys.sparkSession), USER)
    number = F.row_number().over(Window.partitionBy(USER).orderBy(ITEM))
    return rows.withColumn("_chunk", F.floor((number - 1) / F.lit(PACK))).groupBy(USER, "_chunk").agg(
        F.collect_list(ITEM).alias("_asks")).drop("_chunk")


def _rated_packs(rated: DataFrame) -> DataFrame:
    """``(_v, _has, _xs)``: a user's rated items and centred ratings in arrays of at most ``PACK``."""
    number = F.row_number().over(Window.partitionBy("_v").orderBy(ITEM))
    chunks = rated.filter(F.col(ITEM).isNotNull()).withColumn("_chunk", F.floor((number - 1) / F.lit(PACK)))
    packs = chunks.groupBy("_v", "_chunk").agg(F.collect_list(F.struct(ITEM, "_x")).alias("_pack"))
    return packs.select("_v", F.col(f"_pack.{ITEM}").alias("_has"), F.col("_pack._x").alias("_xs"))


def _scored(model: NeighborModel, pairs: DataFrame, sums: DataFrame):
    """``pairs`` with the columns of ``sums``, and the rule that makes a prediction
    of such a sum: the user's mean plus it; for a user without training ratings,
    but with an id up to the largest one, ``GAP_USER_RATING`` (such a user counts
    as padded with one low rating); null for items outside the catalogue.
    """
    known = model.catalogue.select(ITEM, F.lit(True).alias("_known"))
    narrow = pairs.join(model.means.hint("merge"), USER, "left").join(known.hint("merge"), ITEM, "left")
    out = narrow.join(sums.hint("merge"), [USER, ITEM], "left").select(
        *pairs.columns, "user_mean", *[c for c in sums.columns if c not in (USER, ITEM)], "_known")
    padded = F.when(F.col(USER).between(F.lit(1), F.col("_top_id")), F.lit(GAP_USER_RATING))
    # One row of one value; a literal in every task's plan.
    out = out.withColumn("_top_id", model.means.agg(F.max(USER)).scalar())

    def prediction(total: Column) -> Column:
        own = F.col("user_mean") + F.coalesce(total, F.lit(0.0))
        return F.when(F.col("_known"), F.coalesce(own, padded))

    return out, prediction, ("user_mean", "_known", "_top_id")


def predict(model: NeighborModel, pairs: DataFrame, n: int) -> DataFrame:
    """NB10 + NB13: ``pairs`` plus a ``prediction`` column; only the asked pairs are
    scored.  Adds up the rows to come (one job) when called."""
    contributions = _contributions(model, pairs.select(USER, ITEM).distinct(), n)
    sums = contributions.groupBy(USER, ITEM).agg(F.sum("_c").alias("_s"))
    out, prediction, working = _scored(model, pairs, sums)
    return out.withColumn("prediction", prediction(F.col("_s"))).drop("_s", *working)


def recommend(model: NeighborModel, users: DataFrame, n: int, k: int) -> DataFrame:
    """NB12: top-k catalogue items per user, ``(user_id, rank, item_id, score)``.

    Every catalogue item is scored, seen items included.  Items no
    neighbour rated score exactly the user's mean; they are not
    enumerated.  In id-descending catalogue order (position d = 1, 2, ...)
    the best such "fill" items of a user are the first k positions not
    taken by one of the user's candidates (items some neighbour rated).
    The r-th candidate position d has d - r free positions before it, so the
    candidates with d - r < k are those among the first P = k + (their number)
    positions; 1..P without them are the fill.  Work is linear in the
    candidates plus k per user; there is no user x catalogue product.
    Order: rounded score desc, then item desc.

    The join of neighbour lists with ratings multiplies rows: it is spread by
    its measured output, hub neighbours over several tasks.
    """
    lists = _recommended(model, users, n, k)
    return lists.join(_positions(model).select(ITEM, "_d"), "_d").select(USER, "rank", ITEM, "score")


def _recommended(model: NeighborModel, users: DataFrame, n: int, k: int) -> DataFrame:
    """The lists of ``recommend`` by ``_d``, the item's number in the catalogue:
    ``(user_id, rank, score, _d)``.  A neighbour's ratings travel packed, once per
    user who has it in the list; where the user lies they are added up in numpy (``_candidates``),
    which neither makes rows of them nor sorts them twice."""
    who = users.select(USER).distinct().join(model.means.hint("merge"), USER)
    lists = who.join(_active(model, n), USER)
    positions = _positions(model)
    rated = _rated(model)
    loads = measure(lists, rated, "_v")
    parts = tasks_for(users.sparkSession, loads.total)
    packed = _packed(rated.join(positions.hint("merge"), ITEM).select("_v", "_d", "_x"))
    sent = split_join(lists, packed, ["_v"], "_v", loads).select(
        F.col(USER).cast("bigint").alias(USER), "user_mean", "_sim", F.col("_pack._d").alias("_ds"), F.col("_pack._x").alias("_xs"))
    own = sent.repartition(parts, USER).sortWithinPartitions(USER).mapInArrow(
        lambda batches: _candidates(batches, k),
        f"{USER} bigint, _taken array<bigint>, _best array<struct<_d:bigint,score:double>>")
    taken = F.coalesce("_taken", F.array().cast("array<bigint>"))
    free = F.array_except(F.sequence(F.lit(1).cast("bigint"), F.size(taken) + F.lit(k).cast("bigint")), taken)
    every = who.repartition(parts, USER).join(own.hint("merge"), USER, "left").withColumn(
        "_last", positions.agg(F.max("_d")).scalar())
    fill = F.transform(F.filter(free, lambda d: d <= F.col("_last")),
                       lambda d: F.struct(d.alias("_d"), F.col("user_mean").alias("score")))
    best = F.coalesce("_best", F.array().cast("array<struct<_d:bigint,score:double>>"))
    rows = every.select(USER, F.inline(F.concat(best, fill)))
    # The catalogue is numbered by falling id: the smaller number is the larger item.
    ranked = top_k_per_group(rows, [USER], [tie_key("score").desc(), F.col("_d")], k)
    return ranked.select(USER, F.col("rank").cast("int"), "score", "_d")


def _candidates(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of packs sorted by user, each user's candidates that matter: ``_taken``, the positions
    that are taken among the first ones (see ``recommend``), and ``_best``, the ``k`` best.

    Every batch is added up by (user, position) at once; only the sums of its last user, at
    most the catalogue, wait for the next batch.
    """
    waiting = None
    for batch in batches:
        if batch.num_rows:
            user, mean, d, total, seen = _added_up(batch, waiting)
            cut = int(np.searchsorted(user, user[-1], "left"))
            if cut:
                yield _chosen(user[:cut], mean[:cut], d[:cut], total[:cut], seen[:cut], k)
            waiting = (user[cut:], mean[cut:], d[cut:], total[cut:], seen[cut:])
    if waiting is not None and len(waiting[0]):
        yield _chosen(*waiting, k)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values with 0 for null, 1 where there is a value)."""
    known = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    return column.fill_null(0).to_numpy(zero_copy_only=False), known


def _added_up(batch: pa.RecordBatch, waiting: tuple | None) -> tuple[np.ndarray, ...]:
    """(user, mean, position, sum, number of non-null addends) by user and position; a null mean is NaN."""
    users, _ = _numbers(batch.column(0))
    means, has_mean = _numbers(batch.column(1))
    sims, has_sim = _numbers(batch.column(2))
    lists = batch.column(3)
    sizes = np.diff(lists.offsets.to_numpy())
    d = lists.flatten().to_numpy(zero_copy_only=False)
    x, has_x = _numbers(batch.column(4).flatten())
    seen = (np.repeat(has_sim, sizes) & has_x).astype(np.int64)
    user, mean, total = np.repeat(users, sizes), np.repeat(np.where(has_mean, means, np.nan), sizes), np.repeat(sims, sizes) * x * seen
    if waiting is not None:
        user, mean, d, total, seen = (np.concatenate(both) for both in zip(waiting, (user, mean, d, total, seen)))
    order = np.lexsort((d, user))
    user, mean, d, total, seen = user[order], mean[order], d[order], total[order], seen[order]
    if not len(user):
        return user, mean, d, total, seen
    first = np.flatnonzero(np.r_[True, (user[1:] != user[:-1]) | (d[1:] != d[:-1])])
    return user[first], mean[first], d[first], np.add.reduceat(total, first), np.add.reduceat(seen, first)


def _chosen(user: np.ndarray, mean: np.ndarray, d: np.ndarray, total: np.ndarray, seen: np.ndarray, k: int) -> pa.RecordBatch:
    """The arrays of whole users, whose rows are in order of user and position."""
    starts = np.flatnonzero(np.r_[True, user[1:] != user[:-1]])
    sizes = np.diff(np.r_[starts, len(user)])
    who = np.repeat(np.arange(len(starts)), sizes)
    taken = d - (np.arange(len(user)) - starts[who] + 1) < k
    score = mean + total
    known = (seen > 0) & ~np.isnan(mean)
    # Rounded score falling, unknown ones last, then the smaller number.
    order = np.lexsort((d, -np.round(np.where(known, score, 0.0), TIE_DIGITS), ~known, who))
    best = order[np.arange(len(user)) - starts[who] < k]
    ends = lambda rows: pa.array(np.r_[0, np.cumsum(np.bincount(who[rows], minlength=len(starts)))].astype(np.int32))
    pairs = pa.StructArray.from_arrays(
        [pa.array(d[best]), pa.array(score[best], mask=~known[best])], names=["_d", "score"])
    at = np.flatnonzero(taken)
    return pa.RecordBatch.from_arrays(
        [pa.array(user[starts]), pa.ListArray.from_arrays(ends(at), pa.array(d[at])), pa.ListArray.from_arrays(ends(best), pairs)],
        names=[USER, "_taken", "_best"])


def _packed(rated: DataFrame) -> DataFrame:
    """``(_v, _pack)``: a user's ``(_d, _x)`` in arrays of at most ``PACK`` entries."""
    number = F.row_number().over(Window.partitionBy("_v").orderBy("_d"))
    chunks = rated.withColumn("_chunk", F.floor((number - 1) / F.lit(PACK)))
    return chunks.groupBy("_v", "_chunk").agg(F.collect_list(F.struct("_d", "_x")).alias("_pack")).drop("_chunk")


def rmse_report(predictions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """NB14: total RMSE, RMSE by user, RMSE by item."""
    return (
        metrics.rmse(predictions),
        metrics.rmse_by(predictions, USER),
        metrics.rmse_by(predictions, ITEM),
    )


def truth_order():
    return (F.col(RATING).desc(), F.col(ITEM).desc())


def pred_order(pred: str = "prediction"):
    # Equal predictions keep the truth order (a stable sort over it).
    return (tie_key(pred).desc(), F.col(RATING).desc(), F.col(ITEM).desc())


def precision_by_user(predictions: DataFrame, k: int, group=(USER,), pred: str = "prediction") -> DataFrame:
    """NB15 per user: |top-k by rating ∩ top-k by prediction| / k.

    Both cuts are partial top-k aggregations (at most k rows per user and
    map task cross the shuffle).  The denominator is k even for users with
    fewer than k items.
    """
    g = list(group)
    truth = top_k_per_group(predictions, g, truth_order(), k).select(*g, ITEM)
    guess = top_k_per_group(predictions, g, pred_order(pred), k).select(*g, ITEM)
    hits = truth.join(guess, [*g, ITEM]).groupBy(*g).agg(F.count(F.lit(1)).alias("_h"))
    return (
        predictions.select(*g).distinct()
        .join(hits, g, "left")
        .select(*g, (F.coalesce(F.col("_h"), F.lit(0)) / F.lit(float(k))).alias("precision"))
    )


def coverage(model: NeighborModel, frame: DataFrame, n: int, k: int) -> DataFrame:
    """NB16: distinct items recommended to the frame's users over the
    distinct items of the frame.  The lists' items are bits of their catalogue
    numbers, merged inside the tasks: a task sends bitmaps, not its lists."""
    recs = _recommended(model, frame.select(USER).distinct(), n, k)
    return metrics.bitmap_coverage(recs, frame, "_d")


def coverages(model: NeighborModel, frames: Mapping[str, DataFrame], n: int, k: int) -> dict[str, DataFrame]:
    """NB16 for several frames: the lists of all their users are made once."""
    users = reduce(DataFrame.unionByName, [f.select(USER) for f in frames.values()]).distinct()
    recs = materialize(_recommended(model, users, n, k).select(USER, "_d"))
    return {
        name: metrics.bitmap_coverage(recs.join(f.select(USER).distinct(), USER, "left_semi"), f, "_d")
        for name, f in frames.items()
    }


def _curves(model: NeighborModel, frame: DataFrame, max_n: int):
    """``frame`` with ``_curve``, the prefix sums of each row's contributions for
    1..max_n neighbours (null: none), and the prediction rule.

    The prefix sums are ``max_n`` aggregates of one pass over the contributions: a
    pair is one row with one array, however many neighbour counts are asked for.
    The contributions cross the shuffle as they are, narrower than the arrays.
    """
    contributions = _contributions(model, frame.select(USER, ITEM).distinct(), max_n).repartition(
        _parts(model), USER, ITEM)
    upto = [F.sum(F.when(F.col("_r") <= i, F.col("_c")).otherwise(0.0)).alias(f"_s{i}") for i in range(1, max_n + 1)]
    sums = contributions.groupBy(USER, ITEM).agg(*upto).select(
        USER, ITEM, F.array(*[f"_s{i}" for i in range(1, max_n + 1)]).alias("_curve"))
    return _scored(model, frame, sums)


def _numbered(curve: DataFrame, max_n: int, *carried: str) -> DataFrame:
    """One row per neighbour count, ``n`` and its sum ``_s``."""
    none = F.array_repeat(F.lit(0.0), max_n)
    return curve.select(*carried, F.posexplode(F.coalesce("_curve", none)).alias("_at", "_s")).withColumn(
        "n", F.col("_at") + 1).drop("_at")


def sweep_predictions(model: NeighborModel, frame: DataFrame, max_n: int) -> DataFrame:
    """Predictions of every row of ``frame`` for each neighbour count 1..max_n,
    by the same rule as ``predict``.  Rows are multiplied only here, after the
    one join of the arrays.  Extra columns of ``frame`` are carried along."""
    out, prediction, working = _curves(model, frame, max_n)
    rows = _numbered(out, max_n, *frame.columns, *working)
    return rows.withColumn("prediction", prediction(F.col("_s"))).drop("_s", *working)


def _error_curve(curves: DataFrame, prediction, max_n: int, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., n, rmse)`` from the arrays: ``max_n`` averages per group, no row multiplied."""
    at = [F.coalesce(F.get("_curve", F.lit(i)), F.lit(0.0)) for i in range(max_n)]
    errors = [F.avg(F.pow(F.col(RATING) - prediction(s), 2)).alias(f"_e{i}") for i, s in enumerate(at)]
    rows = [F.struct(F.lit(i + 1).alias("n"), F.sqrt(f"_e{i}").alias("rmse")) for i in range(max_n)]
    return curves.groupBy(*by).agg(*errors).select(*by, F.inline(F.array(*rows))).filter("rmse is not null")


def error_curve(model: NeighborModel, frame: DataFrame, max_n: int, by: Sequence[str] = ()) -> DataFrame:
    """RMSE for every neighbour count 1..max_n, per group of ``by``: ``(by..., n, rmse)``."""
    out, prediction, _ = _curves(model, frame, max_n)
    return _error_curve(out, prediction, max_n, by)


def sweep(model: NeighborModel, frame: DataFrame, max_n: int, k: int) -> DataFrame:
    """EX1: RMSE and precision@k for every neighbour count 1..max_n, one job
    (instead of max_n refits): ``(n, rmse, precision)``.

    The rows and their arrays are written once.  The errors are averages over
    the arrays; the predicted top-k per neighbour count is cut inside the tasks
    before it is shuffled, and the truth top-k, which does not depend on n, once.
    """
    rows = frame.select(USER, ITEM, RATING)
    out, prediction, working = _curves(model, rows, max_n)
    out = materialize(out)
    err = _error_curve(out, prediction, max_n)
    # Few bytes become many rows here: spread by what comes out, not by the size of the files.
    tasks = tasks_for(frame.sparkSession, out.count() * max_n)
    longest = out.groupBy(USER).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("_n")).first()["_n"] or 0
    # A user's rows and arrays cross the shuffle once and become a row per neighbour count
    # where they are cut; only where a user has very many are they cut on the way.
    spread = out.repartition(tasks, USER) if longest * max_n <= ROWS_PER_TASK else out.repartition(tasks)
    preds = _numbered(spread, max_n, USER, ITEM, RATING, *working).withColumn("prediction", prediction(F.col("_s")))
    truth = top_k_per_group(rows, [USER], truth_order(), k).select(USER, ITEM)
    guess = top_k_per_group(preds, ["n", USER], pred_order(), k).select("n", USER, ITEM)
    # The neighbour counts whose cut holds an item, as one row of an item.
    cut = guess.groupBy(USER, ITEM).agg(F.collect_list("n").alias("_ns"))
    hits = cut.join(truth.hint("merge"), [USER, ITEM]).select(F.explode("_ns").alias("n")).groupBy("n").agg(
        F.count(F.lit(1)).alias("_h"))
    n_users = rows.select(USER).distinct().agg(F.count(F.lit(1))).scalar()
    prec = hits.select("n", (F.col("_h") / (F.lit(float(k)) * n_users)).alias("precision"))
    # n values with no hit at all still get a row (precision 0)
    return err.join(prec, "n", "left").select(
        "n", "rmse", F.coalesce(F.col("precision"), F.lit(0.0)).alias("precision")
    )
