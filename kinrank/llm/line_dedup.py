"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines stands at every line.
A chunk is a run of lines whose rolling hashes all occur more than once in the
corpus; its boundaries lie where a rolling hash occurs once only.  So they
depend on the content alone and shift with it: a passage is cut out alike
wherever it stands, however short (two lines) and whatever stands around it.
(Boundaries picked by the value of a rolling hash, at one line in four, cut
most short passages in two or miss them; these boundaries miss none.)

A chunk's lines go where they occurred before: a pair of neighbouring lines
that is not the first of its kind, in (doc_id, row, line) order, loses both
lines, but for lines that belong to the first occurrence of a repeated pair.
Those are protected, so every repeated run of lines stays in one place, also
where chunks overlap in chains.  Pairs of two blank lines are no passage.

Rolling hashes (128 bits) are counted first, by partial aggregates without
texts.  The texts of the repeated pairs follow: the smallest and the largest
text of a hash are compared byte by byte, and a hash that stands for several
texts removes nothing.  A hot passage costs one row per task in the
aggregates, and the join back has one unique side, which AQE can split.  Texts
are found by broadcast row numbers while these are few, by a shuffle beyond.

Only DataFrame functions are used.  Defined results: a null text stays null
and has no lines; an empty text is one empty line; rows are separate documents
even if equal (later ones lose what repeats; ties of doc_id go by the order in
which the rows were written); null ids come first; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinrank.llm.common import NOT_WHITE, lines, packed, row_key, unpacked
from kinrank.plans.context import discard, materialize

MIN_LINES = 2
#: Row numbers that may be broadcast to find texts (about 50 bytes each).
BROADCAST_ROWS = 500_000


def _pairs(rows: DataFrame) -> DataFrame:
    """(uid, doc_id, idx, k1, k2) of neighbouring lines, ``idx`` (1-based) that of
    the first, the rolling hash as ``k1`` and ``k2``."""
    hashed = rows.filter("text is not null").select("uid", "doc_id", F.transform(
        lines(F.col("text")), lambda x: F.struct(*row_key(x), x.rlike(NOT_WHITE).alias("wordy"))).alias("h"))
    at = lambda i: (F.get("h", i - 1), F.get("h", i))
    numbers = F.when(F.size("h") > 1, F.sequence(F.lit(1), F.size("h") - 1))
    wordy = F.filter(numbers, lambda i: at(i)[0]["wordy"] | at(i)[1]["wordy"])

    def pair(i: Column) -> Column:
        a, b = at(i)
        return F.struct(i.alias("idx"), *row_key(a["k1"], a["k2"], b["k1"], b["k2"]))

    return hashed.select("uid", "doc_id", F.explode(F.transform(wordy, pair)).alias("p")).select("uid", "doc_id", "p.*")


def _with_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (one row a uid) with the row's columns.  The join is a shuffle at
    every size; while row numbers are few, they keep other texts out of it."""
    if wanted.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(wanted.select("uid")), "uid", "left_semi")
    return rows.join(wanted.hint("merge"), "uid")


def _repeated(rows: DataFrame) -> DataFrame:
    """(uid, later, firsts): line numbers of the repeated pairs of a row that are
    not the first of their kind, and of those that are.  A row's own pairs bound the lists."""
    keys = ["k1", "k2"]
    places = materialize(_pairs(rows))
    place = F.struct("doc_id", "uid", "idx")
    again = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    is_first = place.eqNullSafe(F.col("first"))
    marked = materialize(places.join(again.hint("merge"), keys).select("uid", "idx", *keys, is_first.alias("is_first")))
    wanted = materialize(marked.groupBy("uid").agg(F.collect_list(F.struct("idx", *keys)).alias("pairs")))
    text = F.concat_ws("\n", F.get("lines", F.col("p.idx") - 1), F.get("lines", F.col("p.idx")))
    texts = _with_texts(rows.select("uid", "text"), wanted).select(
        lines(F.col("text")).alias("lines"), F.explode("pairs").alias("p")).select("p.k1", "p.k2", text.alias("pair"))
    several = materialize(
        texts.groupBy(*keys).agg(F.min("pair").alias("lo"), F.max("pair").alias("hi")).filter("lo <> hi").select(*keys))
    found = materialize(marked.join(several, keys, "left_anti").groupBy("uid").agg(
        F.collect_list(F.when(~F.col("is_first"), F.col("idx"))).alias("later"),
        F.collect_list(F.when(F.col("is_first"), F.col("idx"))).alias("firsts")))
    discard(places, marked, wanted, several)
    return found


def _runs(numbers: Column) -> Column:
    """How many runs of consecutive values ``numbers`` has."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("last"))
    total = F.aggregate(F.array_sort(numbers), start, lambda acc, x: F.struct(
        (acc["n"] + F.when(x == acc["last"] + 1, 0).otherwise(1)).alias("n"), x.alias("last")))
    return total["n"]


def assess(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns but ``text``),
    ``doc_id``, ``text``, ``clean_text``, ``n_lines``, ``n_chunks`` (repeated chunks),
    ``removed_chunks`` and ``removed_lines``.  Runs jobs when called."""
    base = docs.select(packed(docs, "text"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(base.withColumn("uid", F.monotonically_increasing_id()))
    found = _repeated(rows)
    both = lambda c: F.array_union(c, F.transform(c, lambda i: i + 1))
    gone = F.array_except(both(F.col("later")), both(F.col("firsts")))
    marks = found.select("uid", gone.alias("gone"), _runs(F.concat("later", "firsts")).alias("n_chunks"))
    none = [F.array().cast("array<int>").alias("gone"), F.lit(0).cast("long").alias("n_chunks")]
    if found.count() <= BROADCAST_ROWS:
        others = rows.join(F.broadcast(found.select("uid")), "uid", "left_anti")
        joined = _with_texts(rows, marks).unionByName(others.select("*", *none))
    else:
        joined = rows.join(marks.hint("merge"), "uid", "left").withColumn(
            "gone", F.coalesce("gone", F.array().cast("array<int>"))).withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    each = lines(F.col("text"))
    numbers = F.array_except(F.sequence(F.lit(1), F.size(each)), "gone")
    kept = joined.withColumn("lines", each).withColumn("left", F.transform(numbers, lambda i: F.get("lines", i - 1)))
    return kept.select(
        "row", "doc_id", "text",
        F.when((F.size("gone") == 0) | F.col("text").isNull(), F.col("text")).otherwise(F.array_join("left", "\n")).alias("clean_text"),
        F.when(F.col("text").isNotNull(), F.size("lines")).otherwise(0).cast("long").alias("n_lines"),
        F.col("n_chunks").cast("long").alias("n_chunks"), _runs(F.col("gone")).alias("removed_chunks"),
        F.size("gone").cast("long").alias("removed_lines"),
    )


#: The name under which the rule for all repeated passages was known before it became the only one.
passages = assess


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with all repeated passages removed, columns as given."""
    return unpacked(assess(docs), docs, text=F.col("clean_text"))
