"""Mixing sources to target weights by iterative proportional fitting (raking).

Cells are (source, language, topic).  Each starts with its tokens; raking
scales the cell weights in turn so that the source, language and topic
marginals meet their targets, until the largest relative error of a marginal
is at most ``tolerance``.  A document of a cell is then sampled with
probability ``min(1, budget * weight / tokens)``: the draw is a hash of the
document's id and text, so it is the same on every recomputation.  A cell
asked for more than it has keeps all its documents, and ``loss_weight`` (at
least 1) tells how much more each should count to meet the target.

Targets default to tempered shares (``tokens ** power``, normalised), which
lowers a source that holds a third of all rows; explicit shares may be given
per marginal.  Only DataFrame functions are used: cells are one partial
aggregate, and each raking step is a window sum over the cell table, whose
rows do not depend on the number of documents.  The cell table is written
every ``CHUNK`` rounds, which also keeps plans short.

Defined results: null source or language is its own group (null); a null
text is empty, with one token (its end mark), like every text has at least;
repeated rows are drawn alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinrank.llm.common import packed, text_of, unpacked, words
from kinrank.plans.context import discard, materialize

MARGINALS = ("source", "lang", "topic")
POWERS = {"source": 0.7, "lang": 0.5, "topic": 0.7}
BUDGET = 0.5
TOLERANCE = 1e-6
CHUNK = 5
MAX_ROUNDS = 50
SEED = 17


def topic_of(text: Column) -> Column:
    """A topic by form, from the whole text: figures, lists, notes, long-form or prose."""
    length = F.length(text)
    digits = length - F.length(F.regexp_replace(text, "[0-9]+", ""))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return (
        F.when(digits * 20 > length, "figures")
        .when((n_lines >= 3) & (length < 60 * n_lines), "list")
        .when(length < 600, "note")
        .when(length >= 6000, "long")
        .otherwise("prose")
    )


def token_count(text: Column) -> Column:
    """Words plus the end mark."""
    return (F.size(words(text)) + 1).cast("long")


def _targets(cells: DataFrame, marginal: str, shares: dict | None) -> DataFrame:
    """(value, target share) of one marginal; shares sum to 1 over the values present."""
    tokens = cells.groupBy(marginal).agg(F.sum("tokens").alias("t"))
    share = F.pow(F.col("t").cast("double"), F.lit(POWERS[marginal]))
    if shares is not None:
        listed = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))])
        share = F.coalesce(listed[F.col(marginal)], F.lit(0.0))
    total = tokens.agg(F.sum(share)).first()[0] or 1.0
    return tokens.select(marginal, (share / F.lit(total)).alias(f"target_{marginal}"))


def rake(cells: DataFrame, targets: dict[str, dict] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (the marginals and ``tokens``) plus ``weight``, summing to 1,
    whose marginals meet the targets.  Runs jobs when called."""
    targets = targets or {}
    state = cells
    for marginal in MARGINALS:
        goal = _targets(cells, marginal, targets.get(marginal))
        same = state[marginal].eqNullSafe(goal[marginal])
        state = state.join(goal, same).drop(goal[marginal])
    state = materialize(state.withColumn("weight", F.col("tokens").cast("double")))
    done = 0
    while done < MAX_ROUNDS:
        step = state
        for _ in range(CHUNK):
            for marginal in MARGINALS:
                total = F.sum("weight").over(Window.partitionBy(marginal))
                step = step.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"target_{marginal}") / total)
                                       .otherwise(F.lit(0.0)))
        after = materialize(step)
        discard(state)
        state, done = after, done + CHUNK
        worst = state
        for marginal in MARGINALS:
            total = F.sum("weight").over(Window.partitionBy(marginal))
            worst = worst.withColumn(f"e_{marginal}", F.abs(total - F.col(f"target_{marginal}")))
        error = worst.agg(F.max(F.greatest(*[f"e_{m}" for m in MARGINALS]))).first()[0]
        if error is None or error <= tolerance:
            break
    return state


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A uniform number in [0, 1) fixed by the document."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id, text), F.lit(1 << 53)) / float(1 << 53)


def assign(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns but ``text``),
    ``text``, the marginals, ``n_tokens``, ``weight`` (of the cell),
    ``probability``, ``loss_weight`` and ``sampled``."""
    text = text_of()
    rows = docs.select(
        packed(docs, "text"), "text", "doc_id", "source", "lang", topic_of(text).alias("topic"),
        token_count(text).alias("n_tokens"),
    )
    cells = materialize(rows.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("tokens")))
    raked = rake(cells, targets)
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    asked = F.when(F.col("tokens") > 0, F.lit(float(budget * total)) * F.col("weight") / F.col("tokens"))
    side = raked.select(*[F.col(m).alias(f"_{m}") for m in MARGINALS], F.col("weight"), asked.alias("asked"))
    same = [rows[m].eqNullSafe(side[f"_{m}"]) for m in MARGINALS]
    small = F.broadcast(side) if raked.count() <= BROADCAST_CELLS else side
    joined = rows.join(small, same[0] & same[1] & same[2])
    probability = F.least(F.lit(1.0), F.col("asked"))
    return joined.select(
        "row", "text", "doc_id", *MARGINALS, "n_tokens", "weight", probability.alias("probability"),
        F.greatest(F.lit(1.0), F.col("asked")).alias("loss_weight"),
        (draw(F.col("doc_id"), text) < probability).alias("sampled"),
    )


#: A cell table up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_CELLS = 100_000


def sample(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET) -> DataFrame:
    """The sampled documents, columns as given."""
    return unpacked(assign(docs, targets, budget).filter("sampled"), docs, text=F.col("text"))
