"""Filter interaction audit: what each quality filter removes in every order.

A document's failures are bits, one per filter.  The steps:

1. Texts whose 128-bit hash stands more than once are the only ones that can
   be copies; the counts are partial aggregates of hashes, no text moves.
2. One pass measures every whole text inside its task and writes the failure
   bits; the text itself goes along only where its hash is shared.
3. E, an existential self-join: a left-semi join on hash, exact text and
   smaller doc_id.  Its right side holds the smallest doc_id of each text, so
   it is unique, and repeated over as many salts as the text's count asks for;
   a text that a third of all documents repeat is spread over many tasks.
4. The ids that fail E are united with the ids and bits of the other filters
   and of the labels; a sum per id gives the combination, a count per (part,
   combination) all that the report needs: at most 128 rows a part.
5. Every combination is charged to each (set of filters before, filter) pair,
   and these sums are looked up for every step of every order.

Defined results: a null text is empty, and empty texts are copies of each
other; a null source is the empty part; a null doc_id is smaller than none and
none is smaller than it, so such a row neither fails E nor makes another fail,
and it has no label; rows that repeat a doc_id count one by one; a label row
counts if any row of its doc_id says so; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from kinrank.llm.common import row_key, text_of
from kinrank.plans.context import discard, materialize

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PCT = 65
MAX_UPPER_PCT = 5
SYMBOLS = b"#$%&*|"
#: Hashes of shared texts that may be broadcast (about 40 MB); beyond, the join shuffles.
BROADCAST_KEYS = 1_000_000
#: Copies of one text that one salt of the semi-join takes.
COPIES_A_SALT = 2_000
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))


def text_failures(text: bytes) -> int:
    """The bits of A to D for one UTF-8 text."""
    found = text.split()  # bytes.split parts at \\x20 and \\x09-\\x0D only
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUED))
    return (
        (len(found) < MIN_WORDS)
        | (100 * len(set(found)) < MIN_DISTINCT_PCT * len(found)) << 1
        | (100 * upper > MAX_UPPER_PCT * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = batch.column(at)
        bits = [text_failures(x.as_py() or b"") for x in texts.cast(pa.binary())]
        if_shared = pc.if_else(batch.column("copies").is_valid(), texts, pa.scalar(None, texts.type))
        yield batch.set_column(at, "text", if_shared).append_column("bits", pa.array(bits, pa.int32()))


def failures(docs: DataFrame, part: str = "source") -> tuple[DataFrame, DataFrame]:
    """The measured rows (uid, doc_id, part, bits, shared texts) as a written
    table, and the uids that fail E.  Runs jobs when called."""
    named = docs.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        text_of().cast("string").alias("text"), *row_key(text_of().cast("string")))
    shared = materialize(named.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    few = shared.count() <= BROADCAST_KEYS
    flagged = named.join(F.broadcast(shared) if few else shared, ["k1", "k2"], "left")
    columns = [StructField(f.name, f.dataType) for f in flagged.schema.fields]  # all nullable: texts may go
    schema = StructType([*columns, StructField("bits", IntegerType())])
    rows = materialize(flagged.mapInArrow(_measured, schema).withColumn("uid", F.monotonically_increasing_id()))
    discard(shared)

    salts = F.ceil(F.col("copies") / COPIES_A_SALT).cast("int")
    again = rows.filter("copies is not null and doc_id is not null").select(
        "uid", "doc_id", "k1", "k2", "text", "copies", F.pmod(F.xxhash64("uid"), salts).cast("int").alias("salt"))
    first = again.groupBy("k1", "k2", "text").agg(F.min("doc_id").alias("least"), F.max("copies").alias("copies"))
    earlier = first.select("k1", "k2", "text", "least", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    a, b = again.alias("a"), earlier.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("k1", "k2", "salt", "text")]
    copies = a.join(b, [*same, F.col("b.least") < F.col("a.doc_id")], "left_semi").select("uid")
    return rows, copies


def combinations(rows: DataFrame, copies: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, documents): counts of every combination of failures and labels."""
    said = labels.groupBy("doc_id").agg(
        (F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0))
         + F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0))).alias("bits"))
    labelled = rows.select("uid", "doc_id").join(said.filter("bits > 0"), "doc_id")
    none = F.lit(None).cast("string").alias("part")
    ids = (
        rows.select("uid", "part", "bits")
        .unionByName(copies.select("uid", none, F.lit(1 << FILTERS.index("E")).alias("bits")))
        .unionByName(labelled.select("uid", none, F.col("bits").cast("int")))
    )
    by_id = ids.groupBy("uid").agg(F.max("part").alias("part"), F.sum("bits").cast("int").alias("bits"))
    return by_id.groupBy("part", "bits").agg(F.count(F.lit(1)).alias("documents"))


def _orders(spark: SparkSession) -> DataFrame:
    """(filter_order, step, before, own) of all orders: a fixed 5 x 120 rows."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            steps.append(("".join(order), step, before, own))
            before |= own
    return spark.createDataFrame(steps, "filter_order string, step int, before int, own int")


def report(found: DataFrame) -> DataFrame:
    """One row per part, filter order and step from ``combinations``."""
    full = (1 << len(FILTERS)) - 1
    pairs = [(before, 1 << i) for i in range(len(FILTERS)) for before in range(full + 1) if not before >> i & 1]
    table = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(o).alias("own")) for b, o in pairs])
    charged = found.withColumn("pair", F.explode(table)).select("part", "bits", "documents", "pair.before", "pair.own")
    fails = F.col("bits").bitwiseAND(F.col("own")) != 0
    fresh = F.col("bits").bitwiseAND(F.col("before")) == 0
    failed = F.bit_count(F.col("bits").bitwiseAND(F.lit(full)))
    orders = 1
    for i in range(2, len(FILTERS) + 1):
        orders *= i

    def total(condition, value=F.col("documents")):
        return F.sum(F.when(condition, value).otherwise(0)).cast("long")

    sums = charged.groupBy("part", "before", "own").agg(
        total(fresh & ~fails).alias("kept"),
        total(fresh & fails).alias("removed"),
        total(~fresh & fails).alias("redundant"),
        total(F.col("bits").bitwiseAND(F.lit(full)) == F.col("own")).alias("unique_fails"),
        total(fresh & fails & (F.col("bits").bitwiseAND(F.lit(GOOD)) != 0)).alias("good_lost"),
        total(fresh & fails & (F.col("bits").bitwiseAND(F.lit(TOXIC)) != 0)).alias("toxic_lost"),
        # Of a document's failing filters each comes first in equally many orders.
        total(fails, F.expr("documents") * F.floor(F.lit(orders) / failed)).alias("shapley"),
    )
    orders_of = F.broadcast(_orders(found.sparkSession))
    return sums.join(orders_of, ["before", "own"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The report over whole ``docs``, one part per value of the column ``part``."""
    rows, copies = failures(docs, part)
    return report(materialize(combinations(rows, copies, labels)))
