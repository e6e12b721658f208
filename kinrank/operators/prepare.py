"""Cleaning, sampling and splitting (PR1-PR9).

``prepare_data`` is the whole chain: cap -> drop singleton users and items
(both counted on the capped frame, one pass) -> keep items with a genre ->
hash split -> four ordered semi-joins.  Each step is also exposed on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinrank import ITEM, RATING, TS, USER
from kinrank.functions.columns import in_train
from kinrank.functions.ranking import global_row_number
from kinrank.functions.selection import first_rows
from kinrank.plans.context import materialize
from kinrank.sources.ratings import NO_GENRE


def cap_sample(ratings: DataFrame, n: int | None, order=(TS, USER, ITEM)) -> DataFrame:
    """PR1: the first ``n`` rows in a fixed order (repeatable), or all if None.

    A filter on the key of the n-th row, which histograms of the order's columns
    find: the table is neither sorted nor written.  Runs jobs when called."""
    return ratings if n is None else first_rows(ratings, list(order), n)


def singleton_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with exactly one row (a partial aggregate: skew-safe)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(key)


def drop_singletons(capped: DataFrame, user: str = USER, item: str = ITEM) -> DataFrame:
    """PR2 + PR3: both key sets are counted on the same input, then removed.

    The sets are written first: mostly they are few, and a join planned with their
    size leaves the ratings where they lie."""
    single_users = materialize(singleton_keys(capped, user))
    single_items = materialize(singleton_keys(capped, item))
    return capped.join(single_users, user, "left_anti").join(single_items, item, "left_anti")


def items_with_genre(items: DataFrame) -> DataFrame:
    """PR4 + PR5: items with a genre, with the title's year (4 chars at -5)."""
    return items.filter(F.col("genres") != NO_GENRE).withColumn(
        "year", F.substring("title", -5, 4)
    )


def keep_items(ratings: DataFrame, items: DataFrame, item: str = ITEM) -> DataFrame:
    """PR6: ratings of the given items (semi-join)."""
    return ratings.join(items.select(item).distinct(), item, "left_semi")


def clean_ratings(ratings: DataFrame, items: DataFrame, n: int | None = None) -> DataFrame:
    """PR1-PR6."""
    return keep_items(drop_singletons(cap_sample(ratings, n)), items_with_genre(items))


def assign_split(
    clean: DataFrame, seed: int = 12345, train_tenths: int = 8, user: str = USER, item: str = ITEM
) -> DataFrame:
    """PR7: add ``is_train`` from the row hash (stable under any layout)."""
    return clean.withColumn("is_train", in_train(user, item, seed, train_tenths))


def _keys(df: DataFrame, keys: list[str]) -> DataFrame:
    # Deduplicated before the shuffle: a hot key sends one row per map task.
    return df.select(*keys).distinct()


def split(
    clean: DataFrame, seed: int = 12345, train_tenths: int = 8, user: str = USER, item: str = ITEM
) -> tuple[DataFrame, DataFrame]:
    """PR7 + PR8: hash split, then four semi-joins in the fixed order.

    train by test users; train by test items; test by the new train users;
    test by the new train items.  One pass, not a fixpoint.
    """
    return split_flagged(assign_split(clean, seed, train_tenths, user, item), user, item)


def split_flagged(flagged: DataFrame, user: str = USER, item: str = ITEM,
                  by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """PR8 on rows already carrying ``is_train``, for each value of ``by`` apart."""
    users, items = [*by, user], [*by, item]
    train0 = flagged.filter("is_train").drop("is_train")
    test0 = flagged.filter(~F.col("is_train")).drop("is_train")
    train = train0.join(_keys(test0, users), users, "left_semi").join(_keys(test0, items), items, "left_semi")
    test = test0.join(_keys(train, users), users, "left_semi").join(_keys(train, items), items, "left_semi")
    return train, test


def nested_samples(ratings: DataFrame, items: DataFrame, sizes: Sequence[int],
                   order=(TS, USER, ITEM)) -> DataFrame:
    """PR1-PR6 for several sample sizes from one numbering: ``sample_size`` plus
    the rating's columns.

    The samples are prefixes of one order.  The rows are numbered once; a row's
    number says which sizes hold it.  A user's (item's) count in every size comes
    from one partial aggregate with a sum per size, and a row goes on into
    those sizes where neither is single: no size is prepared on its own.
    """
    numbered = global_row_number(ratings, list(order), name="_rn")
    inside = [F.sum(F.when(F.col("_rn") <= int(n), 1).otherwise(0)) for n in sizes]

    def counts(key: str, name: str) -> DataFrame:
        return numbered.groupBy(key).agg(F.array(*inside).alias(name))

    listed = F.array(*[
        F.when((F.col("_rn") <= int(n)) & (F.get("_users", F.lit(s)) != 1) & (F.get("_items", F.lit(s)) != 1),
               F.lit(int(n)).cast("bigint"))
        for s, n in enumerate(sizes)
    ])
    kept = (
        numbered.join(counts(USER, "_users"), USER).join(counts(ITEM, "_items"), ITEM)
        .withColumn("sample_size", F.explode(F.array_compact(listed)))
    )
    return keep_items(kept, items_with_genre(items)).select("sample_size", *ratings.columns)


def prepare_data(
    ratings: DataFrame,
    items: DataFrame,
    n: int | None = None,
    seed: int = 12345,
    train_tenths: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """PR1-PR8: ``(train, test)`` with columns user, item, rating, ts."""
    clean = clean_ratings(ratings, items, n)
    return split(clean, seed, train_tenths)


def drop_time(df: DataFrame, ts: str = TS) -> DataFrame:
    """PR9."""
    return df.drop(ts)

