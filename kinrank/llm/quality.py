"""Quality rules: cross-document line frequency per host, plus base rules.

1. Base figures of every whole text (words, symbols, repeated lines,
   repeated 5-word windows) and the base rule on them.
2. Lines are normalised (ASCII white space trimmed and folded, A-Z lowered)
   and hashed.  For every (host, line) the distinct documents are counted.
   A copy of a document is no further evidence that a line is boilerplate,
   so documents whose normalised lines are all equal count as one.
3. Lines found in more than ``max(min_docs, share * documents of the host)``
   distinct documents are removed (``share`` is 0 unless given: a share would
   spare the lines of a hot host); a document left with less than ``min_left`` of
   its words is rejected.

Only DataFrame functions are used.  A hot line or host costs one counter per
map task: the first count is a partial aggregate over all lines, and only
lines above ``min_docs`` rows go on to the distinct count.

Defined results: a null text counts as empty (no words, fails the base
rule); null hosts form one host; repeated rows are separate documents for
the base figures; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinrank.llm.common import (
    NOT_WHITE, WHITE, ascii_lower, lines, md5_long, packed, text_of, unpacked, white_free_length, words,
)
from kinrank.plans.context import discard, materialize

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
MIN_DOCS = 20
SHARE = 0.0
MIN_LEFT = 0.25
#: A table of lines up to this many rows (16 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(line), WHITE + "+", " "))


def _window_hashes(hashes: Column, n: int = WINDOW) -> Column:
    """A hash of every ``n``-word window; ``hashes``: those of the words."""
    starts = F.sequence(F.lit(0), F.size(hashes) - n)
    return F.when(
        F.size(hashes) >= n, F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]))
    ).otherwise(F.array().cast("array<bigint>"))


def _repeated_starts(ordered: Column) -> Column:
    """Starts of windows that occur twice or more; ``ordered``: (hash, start)
    in that order, or null if no window repeats."""
    same = lambda k, j: F.get(ordered, k)["h"] == F.get(ordered, j)["h"]
    repeated = F.filter(
        F.sequence(F.lit(0), F.size(ordered) - 1),
        lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)),
    )
    return F.array_sort(F.transform(repeated, lambda k: F.get(ordered, k)["i"]))


def _covered_words(starts: Column, n: int = WINDOW) -> Column:
    """Words under windows of ``n`` words at the sorted ``starts``."""
    total = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(n), p - acc["last"])).alias("n"), p.alias("last")),
    )
    return F.coalesce(total["n"], F.lit(0)).cast("long")


def base_figures(docs: DataFrame) -> DataFrame:
    """The columns ``row``, ``host`` and ``text`` of ``docs`` plus the base
    figures and the base rule."""
    text = text_of()
    win, ordered = F.col("_win"), F.col("_ordered")
    step = (
        docs.withColumn("_w", F.transform(words(text), lambda w: F.xxhash64(w)))
        .withColumn("_win", _window_hashes(F.col("_w")))
        .withColumn("_ordered", F.when(
            F.size(F.array_distinct(win)) < F.size(win),
            F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ))
        .withColumn("_starts", F.when(ordered.isNotNull(), _repeated_starts(ordered)))
        .withColumn("_wordy", F.filter(lines(text), lambda x: x.rlike(NOT_WHITE)))
    )
    figures = step.select(
        "row", "host", "text",
        F.size("_w").cast("long").alias("n_words"),
        white_free_length(text).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_wordy") - F.size(F.array_distinct("_wordy"))).cast("long").alias("n_dup_lines"),
        _covered_words(F.col("_starts")).alias("n_repeat_words"),
        F.transform(F.transform("_wordy", normalised), lambda x: F.struct(
            md5_long(x).alias("h"), F.size(F.split(x, " ")).alias("n"))).alias("lines"),
    )
    return figures.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")),
    )


def _host_lines(rows: DataFrame) -> DataFrame:
    """One row per line with words: (uid, host, line, n words, context);
    ``context`` tells distinct documents apart."""
    text = F.xxhash64(F.transform("lines", lambda x: x["h"])).alias("context")
    each = rows.select("uid", F.xxhash64("host").alias("host"), text, F.explode("lines").alias("x"))
    return each.select("uid", "host", F.col("x.h").alias("line"), F.col("x.n").alias("n"), "context")


def _matching(rows: DataFrame, wanted: DataFrame, rows_wanted: int) -> DataFrame:
    """``rows`` whose (host, line) is in ``wanted``: broadcast when counted small."""
    side = F.broadcast(wanted) if rows_wanted <= BROADCAST_ROWS else wanted
    return rows.join(side, ["host", "line"])


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(host, line) above the limit of its host; ``rows`` as of _host_lines."""
    often = materialize(
        rows.groupBy("host", "line").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > min_docs).drop("c")
    )
    contexts = _matching(rows.select("host", "line", "context"), often, often.count()).distinct()
    counted = contexts.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
    hosts = rows.select("host", "uid").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    limit = F.greatest(F.lit(float(min_docs)), share * F.col("all"))
    found = materialize(counted.join(hosts, "host").filter(F.col("docs") > limit).select("host", "line"))
    discard(often)
    return found


def assess(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE,
           min_left: float = MIN_LEFT, keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns but ``text``),
    ``text`` (null unless ``keep_text``), the base figures, ``removed_words``
    (in frequent lines), ``boilerplate`` (their hashes) and ``kept``.

    The figures are written once; each row gets a number there, so repeated
    rows stay apart.
    """
    named = docs.select(packed(docs, "text"), F.col(host).alias("host"), "text")
    figures = base_figures(named).withColumn("uid", F.monotonically_increasing_id())
    rows = materialize(figures if keep_text else figures.withColumn("text", F.lit(None).cast("string")))
    found = _host_lines(rows)
    frequent = frequent_lines(found, min_docs, share)
    removed = _matching(found, frequent, frequent.count()).groupBy("uid").agg(
        F.sum("n").alias("removed_words"), F.collect_set("line").alias("boilerplate")
    )
    left = F.col("n_words") - F.col("removed_words")
    depleted = left < min_left * F.col("n_words")
    joined = rows.drop("lines").join(removed, "uid", "left")
    return joined.withColumn("removed_words", F.coalesce("removed_words", F.lit(0))).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(~depleted, F.lit(True))
    )


def without_lines(text: Column, hashes: Column) -> Column:
    """``text`` without the lines whose normalised hash is in ``hashes``."""
    stays = lambda x: ~F.array_contains(hashes, md5_long(normalised(x)))
    return F.when(hashes.isNull(), text).otherwise(F.array_join(F.filter(lines(text), stays), "\n"))


def clean(docs: DataFrame, host: str = "source") -> DataFrame:
    """Kept documents without their boilerplate lines, columns as given
    (``n_chars``, if there, is that of the new text)."""
    fine = assess(docs, host).filter("kept")
    fine = fine.withColumn("text", without_lines(F.col("text"), F.col("boilerplate")))
    return unpacked(fine, docs, text=F.col("text"), n_chars=F.length("text").cast("long"))
