"""Top-k cosine similarity by blocks of users (NB3 -> NB4), without a pair table.

The rows of the normalised user x item matrix are dealt into ``B`` blocks of
users.  Every pair of blocks is one task group: it holds both blocks' entries,
multiplies them item by item (numpy, in stripes of bounded size) and lets out
only the ``k`` best partners of each user there.  A user's final list is the
best ``k`` of its at most ``B * k`` partial ones.  What crosses the shuffle is
each entry once per block that holds a rater of its item (never more often than
the item has raters, however many blocks there are), and the partial lists; the
co-rating pairs themselves, which grow with the square of an item's raters, never
leave a task.  An item that everybody rated is spread evenly over all block pairs.

Where no item has many raters, the co-rating pairs are fewer than the copies and partial
lists that blocks ask for.  Then the pairs themselves are dealt out, packed by their first
user, added up and cut where that user lies (``pair_top_lists``); ``_by_pairs`` weighs
both ways by what they send.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinrank import ITEM, USER
from kinrank.functions.columns import TIE_DIGITS
from kinrank.functions.ranking import top_k_per_group
from kinrank.plans.context import materialize, partition_count

#: Entries (ratings) of one block of users; a group holds two blocks, 24 bytes an entry.
BLOCK_ENTRIES = 4_000_000
#: An item with more raters goes to every block without looking up which ones rate it.
HOT_RATERS = 10_000
#: Dealt entries one map task writes.
DEALT_ROWS = 4_000_000
#: An item with more raters is never dealt as pairs: one task makes all pairs of an item.
PAIR_RATERS = 5_000
#: Co-rating pairs that one task adds up.
PAIRS_PER_TASK = 5_000_000
#: Products evaluated at once inside a task, and cells of a dense stripe.
STRIPE = 4_000_000


def unit_vectors(centered: DataFrame) -> DataFrame:
    """``(item_id, user_id, _x)``: non-zero centred ratings over the norm of all
    of the user's ratings."""
    norms = centered.groupBy(USER).agg(
        F.sqrt(F.sum(F.col("rating_norm") * F.col("rating_norm"))).alias("_norm"))
    return (
        centered.filter(F.col("rating_norm") != 0)
        .join(norms, USER)
        .select(ITEM, USER, (F.col("rating_norm") / F.col("_norm")).alias("_x"))
    )


def block_count(entries: int, tasks: int, block_entries: int = BLOCK_ENTRIES) -> int:
    """Blocks by size; more of them while B (B + 1) / 2 groups are fewer than the tasks."""
    blocks = max(1, -(-entries // block_entries))
    while blocks * (blocks + 1) // 2 < tasks:
        blocks += 1
    return blocks


def _stripes(products: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Ranges of rows with about ``STRIPE`` products and cells each."""
    cost = np.cumsum(np.maximum(products, width))
    cuts, start = [], 0
    while start < len(cost):
        before = cost[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(cost, before + STRIPE, "right")))
        cuts.append((start, end))
        start = end
    return cuts


def _side(table: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(table.column(c).to_numpy() for c in ("user", "item", "x"))


def _best(rows: np.ndarray, partners: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's best ``k`` partners: rounded value, then smaller partner."""
    order = np.lexsort((partners, -np.round(values, TIE_DIGITS), rows))
    sorted_rows = rows[order]
    first = np.searchsorted(sorted_rows, sorted_rows, "left")
    return order[np.arange(len(order)) - first < k]


def _products(a: tuple, b: tuple):
    """(users of a, users of b, cosine) of all pairs that share an item, in stripes."""
    users_a, row = np.unique(a[0], return_inverse=True)
    users_b, column = np.unique(b[0], return_inverse=True)
    by_item = np.argsort(b[1], kind="stable")
    items, column, other = b[1][by_item], column[by_item], b[2][by_item]
    by_row = np.argsort(row, kind="stable")
    row, wanted, own = row[by_row], a[1][by_row], a[2][by_row]
    low, high = np.searchsorted(items, wanted, "left"), np.searchsorted(items, wanted, "right")
    matches = high - low
    per_row = np.bincount(row, matches, len(users_a)).astype(np.int64)
    starts = np.searchsorted(row, np.arange(len(users_a) + 1))
    width = len(users_b)
    for r0, r1 in _stripes(per_row, width):
        part = slice(starts[r0], starts[r1])
        n = matches[part]
        total = int(n.sum())
        if not total:
            continue
        inside = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(low[part], n) + inside
        cell = np.repeat(row[part] - r0, n) * width + column[at]
        product = np.repeat(own[part], n) * other[at]
        cells = (r1 - r0) * width
        if cells <= 4 * total:
            sums = np.bincount(cell, product, cells)
            touched = np.zeros(cells, bool)
            touched[cell] = True
            found = np.flatnonzero(touched)
            sums = sums[found]
        else:
            found, index = np.unique(cell, return_inverse=True)
            sums = np.bincount(index, product, len(found))
        yield users_a[found // width + r0], users_b[found % width], sums


def _pair_of_blocks(table: pa.Table, k: int, symmetric: bool) -> pa.Table:
    """The partial top lists of one pair of blocks."""
    second = table.column("second").to_numpy()
    one = table.column("p")[0].as_py() == table.column("q")[0].as_py()
    a = _side(table.filter(pa.array(~second)))
    b = a if one else _side(table.filter(pa.array(second)))
    kept: list[tuple] = []

    def keep(i: np.ndarray, j: np.ndarray, value: np.ndarray) -> None:
        best = _best(i, j, value, k)
        kept.append((i[best], j[best], value[best]))

    later: list[tuple] = []
    if len(a[0]) and len(b[0]):
        for i, j, value in _products(a, b):
            forward = (i != j) if symmetric else (i < j)
            keep(i[forward], j[forward], value[forward])
            if not one:
                back = np.ones(len(i), bool) if symmetric else j < i
                later.append((j[back], i[back], value[back]))
                if sum(len(x[0]) for x in later) > STRIPE:
                    later = [_cut(later, k)]
    if later:
        kept.append(_cut(later, k))
    i, j, value = (np.concatenate([x[c] for x in kept]) if kept else np.empty(0) for c in range(3))
    return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "value": pa.array(value, pa.float64())})


def _cut(parts: list[tuple], k: int) -> tuple:
    i, j, value = (np.concatenate([x[c] for x in parts]) for c in range(3))
    best = _best(i, j, value, k)
    return i[best], j[best], value[best]


def _dealt(entries: DataFrame, count: int, tasks: int) -> DataFrame:
    """``entries`` with ``other``, once for each block that holds a rater of the item.

    The blocks are looked up by item in a shuffle join; an item with more than
    ``HOT_RATERS`` raters, of which there are few, is dealt to all blocks where it lies.
    """
    # A user's repeated ratings of an item may count more than once here: only the way changes.
    raters = materialize(entries.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.collect_set("own").alias("others")))
    hot = F.broadcast(raters.filter(F.col("n") > HOT_RATERS).select("item"))
    some = raters.filter((F.col("n") > 1) & (F.col("n") <= HOT_RATERS)).select("item", "others")
    looked_up = entries.join(hot, "item", "left_anti").repartition(tasks, "item").join(
        some.repartition(tasks, "item").hint("merge"), "item")
    everywhere = entries.join(hot, "item", "left_semi").withColumn("others", F.sequence(F.lit(0), F.lit(count - 1)))
    return looked_up.unionByName(everywhere).select("user", "item", "x", "own", F.explode("others").alias("other"))


def partial_top_lists(centered: DataFrame, k: int, symmetric: bool = False,
                      blocks: int | None = None) -> DataFrame:
    """``(i, j, value)``: at most ``k`` partners of a user per block of partners."""
    spark = centered.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = centered.count()
    count = blocks or block_count(size, 2 * cores)
    block = F.pmod(F.xxhash64(USER), F.lit(count)).cast("int")
    entries = unit_vectors(centered).select(
        F.col(USER).cast("long").alias("user"), F.col(ITEM).cast("long").alias("item"), F.col("_x").alias("x"),
        block.alias("own"))
    dealt = _dealt(entries, count, max(cores, size * count // DEALT_ROWS)).select(
        F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
        (F.col("own") > F.col("other")).alias("second"), "user", "item", "x")
    groups = count * (count + 1) // 2
    # Groups fall on partitions by hash; more partitions than groups keep few of them together.
    tasks = min(2 * groups, max(4 * partition_count(spark), groups // 4))
    spread = dealt.repartition(tasks, "p", "q")
    return spread.groupBy("p", "q").applyInArrow(
        lambda table: _pair_of_blocks(table, k, symmetric), "i bigint, j bigint, value double")


class PairLoad(NamedTuple):
    """What decides between pairs and blocks."""

    entries: int
    pairs: int  # of raters of the same item
    most: int  # raters of one item
    low: int  # user ids
    high: int


def pair_load(centered: DataFrame) -> PairLoad:
    """Counts of the non-zero centred ratings: partial aggregates, one row."""
    raters = centered.filter(F.col("rating_norm") != 0).filter(F.col(ITEM).isNotNull()).groupBy(ITEM).agg(
        F.count(F.lit(1)).alias("_n"), F.min(USER).alias("_low"), F.max(USER).alias("_high"))
    found = raters.agg(
        F.sum("_n").alias("entries"), F.sum(F.col("_n") * (F.col("_n") - 1) / 2).cast("bigint").alias("pairs"),
        F.max("_n").alias("most"), F.min("_low").alias("low"), F.max("_high").alias("high")).first()
    return PairLoad(*(int(x or 0) for x in found))


def _by_pairs(load: PairLoad, k: int, symmetric: bool, blocks: int) -> bool:
    """Whether the pairs are fewer bytes than the entries dealt to blocks and the blocks' lists."""
    if load.most > PAIR_RATERS:
        return False
    pairs = load.pairs * (2 if symmetric else 1)
    lists = min(pairs, load.entries * k * blocks)
    return 16 * pairs <= 24 * (load.entries * min(blocks, load.most) + lists)


def pair_sums(centered: DataFrame, load: PairLoad, symmetric: bool = False) -> DataFrame:
    """``(i, j, value)`` of all co-rating pairs, i < j unless ``symmetric``, partitioned by i.

    An item's raters are listed by user; every rater takes the part of the list behind
    it (``symmetric``: all of it) along to where its own sums are made, as two plain
    arrays.  That is the only shuffle of pairs, and one task adds up about
    ``PAIRS_PER_TASK`` of them.
    """
    tasks = max(partition_count(centered.sparkSession), -(-load.pairs * (2 if symmetric else 1) // PAIRS_PER_TASK))
    # Half the bytes where the ids allow it.
    user = F.col(USER).cast("int" if load.low >= -(2**31) and load.high < 2**31 else "long")
    raters = unit_vectors(centered).filter(F.col(ITEM).isNotNull()).groupBy(ITEM).agg(
        F.sort_array(F.collect_list(F.struct(user.alias("user"), F.col("_x").alias("x")))).alias("_all"))
    own = raters.filter(F.size("_all") > 1).select("_all", F.posexplode("_all").alias("_at", "_own"))
    others = F.col("_all") if symmetric else F.slice("_all", F.col("_at") + 2, F.size("_all"))
    dealt = own.select(
        F.col("_own.user").cast("long").alias("i"), F.col("_own.x").alias("_xi"), others.alias("_others")
    ).filter(F.size("_others") > 0).select(
        "i", "_xi", F.col("_others.user").alias("_js"), F.col("_others.x").alias("_xs")).repartition(tasks, "i")
    products = dealt.select("i", "_xi", "_xs", F.posexplode("_js").alias("_at", "j")).select(
        "i", F.col("j").cast("long").alias("j"), (F.col("_xi") * F.get("_xs", F.col("_at"))).alias("_product"))
    return products.filter("i <> j").groupBy("i", "j").agg(F.sum("_product").alias("value"))


def pair_top_lists(centered: DataFrame, load: PairLoad, k: int, symmetric: bool = False) -> DataFrame:
    """``(i, j, value, row_number)`` through ``pair_sums``; the lists are cut where the sums are made."""
    order = [F.round("value", TIE_DIGITS).desc(), F.col("j")]
    ranked = top_k_per_group(pair_sums(centered, load, symmetric), ["i"], order, k, name="row_number")
    return ranked.select("i", "j", "value", F.col("row_number").cast("int"))


def blocked_top_neighbors(centered: DataFrame, max_neighbors: int = 100, symmetric: bool = False,
                          blocks: int | None = None) -> DataFrame:
    """NB3 + NB4: ``(i, j, value, row_number)``, the ``max_neighbors`` most similar
    j of each i (i < j unless ``symmetric``), ties to the smaller j.  ``blocks`` given:
    by that many blocks; otherwise by pairs or blocks, whichever sends less."""
    if blocks is None:
        load = pair_load(centered)
        count = block_count(load.entries, 2 * centered.sparkSession.sparkContext.defaultParallelism)
        if _by_pairs(load, max_neighbors, symmetric, count):
            return pair_top_lists(centered, load, max_neighbors, symmetric)
    partial = partial_top_lists(centered, max_neighbors, symmetric, blocks)
    order = [F.round("value", TIE_DIGITS).desc(), F.col("j")]
    ranked = top_k_per_group(partial, ["i"], order, max_neighbors, name="row_number")
    return ranked.select("i", "j", "value", F.col("row_number").cast("int"))


def pair_similarity(centered: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosine of asked user pairs: ``pairs`` (i, j) once each plus ``value``, null
    where the two share no item with non-zero centred ratings.

    The first user's entries go to the pair, then the second's by (user, item):
    work is the ratings of the asked first users, whatever the table's size.
    """
    vectors = unit_vectors(centered)
    asked = pairs.select("i", "j").distinct()
    first = asked.join(vectors.select(F.col(USER).alias("i"), ITEM, F.col("_x").alias("_xi")), "i")
    both = first.join(vectors.select(F.col(USER).alias("j"), ITEM, F.col("_x").alias("_xj")), ["j", ITEM])
    sums = both.groupBy("i", "j").agg(F.sum(F.col("_xi") * F.col("_xj")).alias("value"))
    return asked.join(sums, ["i", "j"], "left")
