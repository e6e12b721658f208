"""MinHash near-dedup by fast similarity sketching, banding, exact checks.

Sketch (Dahlgaard, Knudsen, Thorup 2017): ``t`` bins; in round i < t every
shingle is thrown into a random bin with value (i, random); in round t + j
every shingle goes to bin j.  A bin keeps its smallest value, and rounds stop
once all bins are filled, so every coordinate fills after at most 2t rounds
and about t ln t hashes, with concentration as for t independent min-hashes.

1. Texts with equal shingle sets form one class (its smallest row number).
2. The sketch is cut into ``bands`` of ``t / bands`` coordinates; classes that
   share a band are candidates.  At similarity 0.8, 32 bands of 4 miss a pair
   with probability (1 - 0.8^4)^32 = 5e-8.
3. Star: the centre of a bucket is the class that meets the most others over
   all bands (for edited copies, usually their original).  Every class of the
   bucket is checked against it on full shingle sets; components of the
   confirmed links follow.
4. Rest: buckets whose other classes still lie in several components are cut
   into blocks of about ``BLOCK`` shingles.  Each pair of blocks is one task
   group: pairs of different components that first meet in this band and
   whose sketches agree in ``PRUNE`` of the coordinates (0.6: 5.6 standard
   deviations under 0.8) are checked there on full sets, and only links leave
   it.  No bucket is collected whole, none is capped.
5. Components of all confirmed links; the smallest doc_id names each one.

Defined results: a null or empty text, or one without words, has no shingles
and is linked with nothing; repeated rows have equal sets, so they share a
component; a null doc_id never names a component unless all are null, and is
not kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from kinrank.llm.common import packed, unpacked
from kinrank.llm.graph import components
from kinrank.llm.wordhash import WordHasher, mix, shingle_set
from kinrank.plans.context import discard, materialize

BINS = 128
BANDS = 32
SIMILAR_PCT = 80
BLOCK = 400_000
PRUNE = 0.6
BATCH = 500  # rows of an Arrow batch where texts go through Python
WANTED = 2_000_000  # row numbers broadcast at once when texts are looked up
REMEMBERED = 500_000  # shingles of recent sets that the check of links keeps
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _in_small_batches(df: DataFrame) -> DataFrame:
    """``materialize`` with Arrow batches of ``BATCH`` rows: a batch of whole
    texts is held by the JVM and by Python at once."""
    conf = df.sparkSession.conf
    before = conf.get(_BATCH_ROWS)
    conf.set(_BATCH_ROWS, min(BATCH, int(before)) if int(before) > 0 else BATCH)
    try:
        return materialize(df)
    finally:
        conf.set(_BATCH_ROWS, before)


def sketch(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes."""
    filled = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    rounds, at = max(1, 6 * bins // len(shingles)), 0
    while at < 2 * bins and filled.max() == np.iinfo(np.uint64).max:
        upto = min(at + rounds, 2 * bins)
        thrown = mix(shingles[None, :] ^ _SEEDS[at:upto, None])
        number = np.arange(at, upto, dtype=np.uint64)[:, None]
        bin_of = np.where(number < bins, thrown % np.uint64(bins), number - np.uint64(bins))
        np.minimum.at(filled, bin_of.ravel().astype(np.intp), ((number << np.uint64(56)) | (thrown >> np.uint64(8))).ravel())
        at = upto
    return mix(filled).astype(np.uint32).view(np.int32)


def _sketched(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        sizes, keys, sketches = [], ([], []), []
        for text in batch.column("text"):
            found = shingle_set(hasher(text.as_py()), words)
            sizes.append(len(found))
            if len(found) == 0:
                sketches.append(None)
                for key in keys:
                    key.append(None)
                continue
            sketches.append(sketch(found))
            for seed, key in enumerate(keys, 1):
                key.append(int(_set_hash(found, seed)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sizes, pa.int64()), *[pa.array(k, pa.int64()) for k in keys],
             pa.array(sketches, pa.list_(pa.int32()))],
            [*batch.schema.names, "n_shingles", "k1", "k2", "sketch"],
        )


def _set_hash(found: np.ndarray, seed: int) -> np.int64:
    """64 bits of a set's identity: the sum of its mixed elements, mixed with the size."""
    total = mix(found + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))).sum(dtype=np.uint64)
    return mix(np.array([total + np.uint64(len(found))], np.uint64)).view(np.int64)[0]


def _buckets(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(band, h, uid) of every class; only band hashes, half as long as the sketches, are shuffled."""
    width = BINS // BANDS
    hashes = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.slice("sketch", i * width + 1, width))
    )
    hashed = rows.select(F.col("uid").alias("cid"), hashes.alias("hashes"))
    return hashed.join(classes.select("cid"), "cid").select(
        F.col("cid").alias("uid"), F.posexplode("hashes").alias("band", "h"))


def _looked_up(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, n_shingles, sketch, text) of the rows in ``wanted`` (uid), written
    as a table without shuffling any text.

    The upper bits of a uid number the task that wrote the row, so a range of
    uids is a range of files.  ``wanted`` is cut at task borders into ranges of
    about ``WANTED`` (beyond it only if one task wrote more); each is broadcast
    to the files of its own range, so every text is read once at any size.
    """
    per_task = wanted.groupBy(F.shiftright("uid", 33).alias("task")).count().orderBy("task").collect()
    starts, held = [0], 0
    for task, n in per_task:  # one row per task of the scan
        if held and held + n > WANTED:
            starts.append(task << 33)
            held = 0
        held += n
    parts = []
    for low, high in zip(starts, [*starts[1:], 1 << 62]):
        inside = (F.col("uid") >= low) & (F.col("uid") < high)
        ids = F.broadcast(wanted.filter(inside))
        parts.append(rows.filter(inside).select("uid", "n_shingles", "sketch", "text").join(ids, "uid", "left_semi"))
    return materialize(reduce(DataFrame.unionByName, parts))


def _confirmed(pairs: DataFrame, near: DataFrame, words: int, pct: int) -> DataFrame:
    """Pairs (a, b) of classes with ``100 |A n B| >= pct |A u B|`` on full sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, last, held = WordHasher(), {}, 0

        def of(uid: int, text: pa.StringScalar) -> np.ndarray:
            nonlocal held
            if uid not in last:
                if held >= REMEMBERED:
                    last.clear()
                    held = 0
                last[uid] = shingle_set(hasher(text.as_py()), words)
                held += len(last[uid])
            return last[uid]

        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            ta, tb = batch.column("ta"), batch.column("tb")
            good = []
            for i in range(batch.num_rows):
                x, y = of(a[i], ta[i]), of(b[i], tb[i])
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= pct * (len(x) + len(y) - common):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    texts = near.select("uid", "text")
    with_a = pairs.join(texts.withColumnsRenamed({"uid": "a", "text": "ta"}), "a")
    both = with_a.join(texts.withColumnsRenamed({"uid": "b", "text": "tb"}), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint")


def _with_sets(members: DataFrame, near: DataFrame, words: int) -> DataFrame:
    """(uid, sketch, shingles as bytes, n_shingles) of the classes in ``members``."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sets = [shingle_set(hasher(text.as_py()), words).tobytes() for text in batch.column("text")]
            yield batch.drop_columns(["text"]).append_column("shingles", pa.array(sets, pa.binary()))

    wanted = near.join(members.select("uid").distinct(), "uid", "left_semi")
    return wanted.select("uid", "n_shingles", "sketch", "text").mapInArrow(
        full, "uid bigint, n_shingles bigint, sketch array<int>, shingles binary")


def _blocked_links(members: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Confirmed links (a, b) between different components inside the blocks
    of a bucket.  ``members``: (band, h, uid, root)."""
    known = members.join(sets.select("uid", "n_shingles"), "uid")
    sizes = known.groupBy("band", "h").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("s"))
    own = F.pmod(F.xxhash64("uid"), F.col("s")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("s") - 1))
    dealt = (
        members.join(sizes, ["band", "h"])
        .select("band", "h", "uid", "root", own.alias("own"), other.alias("other"))
        .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        .join(sets, "uid").select("band", "h", "i", "j", "own", "uid", "root", "sketch", "shingles")
    )

    def compare(group: pa.Table) -> pa.Table:
        uid, root, own = (group.column(c).to_numpy() for c in ("uid", "root", "own"))
        band, i, j = (group.column(c)[0].as_py() for c in ("band", "i", "j"))
        marks = group.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, BINS)
        sets_ = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")]
        ends = np.cumsum([len(x) for x in sets_])
        values, dense = np.unique(np.concatenate(sets_), return_inverse=True)
        ids = np.split(dense, ends[:-1])
        held, links = np.zeros(len(values), bool), []
        for x in np.flatnonzero(own == i):
            ys = np.flatnonzero((own == j) & (root != root[x]) & ((uid > uid[x]) if i == j else True))
            same = marks[ys] == marks[x]
            first = same.reshape(len(ys), BANDS, BINS // BANDS).all(2).argmax(1)
            held[ids[x]] = True
            for y in ys[(same.mean(1) >= PRUNE) & (first == band)]:
                common = int(np.count_nonzero(held[ids[y]]))
                if 100 * common >= pct * (len(ids[x]) + len(ids[y]) - common):
                    links.append((uid[x], uid[y]))
            held[ids[x]] = False
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return dealt.groupBy("band", "h", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def _linked(rows: DataFrame, classes: DataFrame, words: int, pct: int) -> DataFrame:
    """(node, root) of classes that have confirmed links."""
    buckets = materialize(_buckets(rows, classes))
    sizes = buckets.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(buckets.join(sizes, ["band", "h"]))
    discard(buckets)
    degrees = shared.groupBy("uid").agg(F.sum("n").alias("degree"))
    ranked = shared.select("band", "h", "uid").join(degrees, "uid")
    centres = ranked.groupBy("band", "h").agg(F.max(F.struct("degree", "uid")).alias("most"))
    crowded = materialize(
        shared.select("band", "h", "uid").join(centres.select("band", "h", F.col("most.uid").alias("a")), ["band", "h"])
        .filter("uid <> a")
    )
    discard(shared)
    star = materialize(crowded.select(F.least("a", "uid").alias("a"), F.greatest("a", "uid").alias("b")).distinct())
    wanted = materialize(star.select(F.explode(F.array("a", "b")).alias("uid")).distinct())
    near = _looked_up(rows, wanted)
    links = _in_small_batches(_confirmed(star, near, words, pct))
    discard(star, wanted)
    first = materialize(components(links))
    members = crowded.join(first, crowded["uid"] == first["node"], "left").select(
        "band", "h", "uid", F.coalesce("root", "uid").alias("root")
    )
    open_ = members.groupBy("band", "h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    rest = materialize(members.join(open_.select("band", "h"), ["band", "h"]))
    sets = _in_small_batches(_with_sets(rest, near, words))
    discard(near)
    found = materialize(_blocked_links(rest, sets, pct))
    discard(crowded, rest, sets)
    if found.isEmpty():
        return first
    joined = materialize(components(links.unionByName(found)))
    discard(first, links, found)
    return joined


def assign(docs: DataFrame, words: int = 4, pct: int = SIMILAR_PCT) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns but ``text``),
    ``text``, ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``
    (``doc_id`` = ``component_id``).  Runs jobs when called."""
    named = docs.select(packed(docs, "text"), "doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([
        *named.schema.fields, *[StructField(c, LongType()) for c in ("n_shingles", "k1", "k2")],
        StructField("sketch", ArrayType(IntegerType())),
    ])
    rows = _in_small_batches(
        named.mapInArrow(lambda batches: _sketched(batches, words), schema)
        .withColumn("uid", F.monotonically_increasing_id())
    )
    keyed = rows.filter("n_shingles > 0")
    classes = materialize(keyed.groupBy("k1", "k2").agg(F.min("uid").alias("cid"), F.min("doc_id").alias("least")))
    roots = _linked(keyed, classes, words, pct)
    of_class = classes.join(roots, classes["cid"] == roots["node"], "left").withColumn(
        "root", F.coalesce("root", "cid"))
    names = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named_classes = of_class.join(names, "root").select("k1", "k2", "component_id")
    columns = ["row", "text", "doc_id", "n_shingles", "component_id"]
    linked = keyed.join(named_classes, ["k1", "k2"]).select(*columns)
    alone = rows.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")).select(*columns)
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def dedup(docs: DataFrame, words: int = 5, pct: int = SIMILAR_PCT) -> DataFrame:
    """One document of each group of near copies, columns as given."""
    return unpacked(assign(docs, words, pct).filter("kept"), docs, text=F.col("text"))
