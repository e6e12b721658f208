"""Substring dedup by relative Lempel-Ziv parsing against blocks of earlier text.

Every document is parsed greedily into factors: runs of words that also stand
earlier in the table (in a smaller doc_id, or before in the same document).
Factors of ``WINDOW`` words or more are duplicate spans, and their words go.
The reference is the whole table; its index is cut into blocks by content:

1. Every window of ``WINDOW`` words belongs to its minimiser, the run of
   ``GRAM`` words in it with the smallest hash (the leftmost of equal ones).
   Neighbouring windows of one minimiser form a phrase, about nine words on.
   Equal windows have equal minimisers, so the block of an anchor (the hash of
   the minimiser) indexes every place where a window of the phrase can occur:
   looking a phrase up there is looking it up in all blocks.
2. Anchors that stand once in the table end there (a partial count of hashes).
   Phrases of the others meet in their anchor's block.  Equal phrases match as
   a whole, the earliest being the source of the others.
3. Factor boundaries: where an anchor has several different phrases, text that
   is equal ends within them.  The earliest phrase of each kind is cut into its
   windows, which are looked up one by one.  Only what differs gets this far.
4. A document's matches (start, source), at most one a word, are parsed from
   left to right: a factor takes the match at its start and goes on while the
   source goes on; the windows across its end are looked at one by one.

All steps are joins and partial aggregates whose keys are phrases or windows;
no group is collected but the matches of one document.  Keys are the 64-bit
hash of the anchor together with one of the phrase or window (128 bits); words
are taken as they are.

Defined results: a null text has no words; texts under ``WINDOW`` words lose
nothing; a null doc_id comes after all others; rows of one doc_id are ordered
by their place in the table as written, so repeated rows keep one; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kinrank.llm.common import packed, unpacked
from kinrank.llm.wordhash import mix
from kinrank.plans.context import discard, materialize

WINDOW = 20
GRAM = 6
#: Bytes of text whose words are hashed at once in a task (about 25 bytes of memory each).
PORTION = 500_000
#: Row numbers that may be broadcast to find texts (about 50 bytes each); beyond, the texts are shuffled.
BROADCAST_ROWS = 500_000
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAEF17502108EF2D9)  # odd, so they have inverses modulo 2^64
_INVERSES = tuple(pow(base, -1, 1 << 64) for base in _BASES)
_BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[0]))
_IN_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_PLACE = np.uint64((1 << 20) - 1)  # low bits of a minimiser's rank, the place in its text
_NOTHING = hashlib.sha256(b"").hexdigest()


def _powers(base: int, n: int, _held: dict[int, np.ndarray] = {}) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; remembered by the worker."""
    powers = _held.get(base)
    if powers is None or len(powers) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        powers = _held[base] = np.cumprod(steps)
    return powers[:n]


class _Rolling:
    """Hashes of any runs of a sequence, from prefix sums modulo 2^64."""

    def __init__(self, values: np.ndarray, base: int, inverse: int):
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(base, len(values)), out=self._sums[1:])
        self._back = _powers(inverse, len(values) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._back[starts])


def _rolling(values: np.ndarray, which: int) -> _Rolling:
    return _Rolling(values, _BASES[which], _INVERSES[which])


class Words(NamedTuple):
    """The words of several texts: their hashes, and where each text's begin
    (one entry more than texts)."""

    hashes: np.ndarray
    begins: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words (runs outside the white space) of texts that lie one after another in ``data``."""
    if not len(data):
        return Words(np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = _IN_WORD[data]
    start, end = inside.copy(), inside.copy()
    cut = offsets[(offsets > 0) & (offsets < len(data))]  # a word ends with its text
    joined = np.ones(len(data), bool)
    joined[cut] = False
    start[1:] &= ~(inside[:-1] & joined[1:])
    end[:-1] &= ~(inside[1:] & joined[1:])
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(_rolling(_BYTE_HASH[data], 2)(starts, ends), np.searchsorted(starts, offsets))


class Phrases(NamedTuple):
    text: np.ndarray  # number of the text
    start: np.ndarray  # first window, counted in words of the text
    windows: np.ndarray
    anchor: np.ndarray
    key: np.ndarray


def phrases(words: Words, window: int = WINDOW, gram: int = GRAM) -> Phrases:
    """The phrases of all texts.

    The minimiser of a window is the smallest (hash, place) of its ``window -
    gram + 1`` runs; minima of 1, 2, 4, ... runs give it in a few passes.
    """
    hashes, begins = words
    windows = len(hashes) - window + 1
    if windows <= 0:
        none = np.empty(0, np.int64)
        return Phrases(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    at = np.arange(len(hashes) - gram + 1)
    grams = _rolling(hashes, 0)(at, at + gram)
    least = (grams & ~_PLACE) | (at.astype(np.uint64) & _PLACE)
    wanted, span = window - gram + 1, 1
    while 2 * span <= wanted:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wanted:
        least = np.minimum(least[:len(least) - (wanted - span)], least[wanted - span:])
    ends = np.maximum(np.diff(begins) - window + 1, 0) + begins[:-1]  # after each text's last window
    here = np.zeros(windows + 1, np.int64)
    np.add.at(here, begins[:-1][ends > begins[:-1]], 1)
    np.add.at(here, ends[ends > begins[:-1]], -1)
    valid = np.cumsum(here[:-1]) > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    starts = np.flatnonzero(first)
    text = np.searchsorted(begins, starts, "right") - 1
    counts = np.minimum(np.append(starts[1:], windows), ends[text]) - starts
    behind = (starts.astype(np.uint64) & _PLACE)
    place = starts + (((least[starts] & _PLACE) - behind) & _PLACE).astype(np.int64)
    return Phrases(text, starts - begins[text], counts, grams[place],
                   _rolling(hashes, 1)(starts, starts + counts + window - 1))


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    """(first row, rows, words) of portions of about ``PORTION`` bytes of text, or one text."""
    column = batch.column("text").cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PORTION, "right")) - 1)
        yield row, end - row, words_of(data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row])
        row = end


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def one_spaced(text: bytes) -> bytes:
    """The words of ``text`` joined by one space."""
    spaced = text.translate(_TO_SPACE)
    if b"  " in spaced or spaced[:1] == b" " or spaced[-1:] == b" ":
        return b" ".join(text.split())
    return spaced


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha = [], []
        for text in batch.column("text").cast(pa.binary()):
            words = one_spaced(text.as_py() or b"")
            n.append(words.count(b" ") + 1 if words else 0)
            sha.append(hashlib.sha256(words).hexdigest())
        yield batch.append_column("n_words", pa.array(n, pa.int64())).append_column("sha", pa.array(sha, pa.string()))


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, words in _portions(batch):
            yield pa.RecordBatch.from_arrays([_signed(phrases(words, window).anchor)], ["a"])


_PHRASE = "a bigint, c bigint, doc_id bigint, uid bigint, start bigint, windows bigint"


def _phrases(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, rows, words in _portions(batch):
            found = phrases(words, window)
            part, take = batch.slice(row, rows), pa.array(found.text)
            yield pa.RecordBatch.from_arrays(
                [_signed(found.anchor), _signed(found.key), part.column("doc_id").take(take),
                 part.column("uid").take(take), _signed(found.start), _signed(found.windows)],
                ["a", "c", "doc_id", "uid", "start", "windows"])


_WINDOW_ROW = "a bigint, w bigint, doc_id bigint, uid bigint, start bigint"


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows of the phrases listed in ``edges``, one row each."""
    for batch in batches:
        for row, rows, words in _portions(batch):
            part = batch.slice(row, rows)
            edges = part.column("edges")
            columns = edges.flatten()
            start, counts, anchor = (columns.field(c).to_numpy() for c in ("start", "windows", "a"))
            text = np.repeat(np.arange(rows), edges.value_lengths().to_numpy())
            inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            text, start, anchor = np.repeat(text, counts), np.repeat(start, counts) + inside, np.repeat(anchor, counts)
            at, take = words.begins[text] + start, pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [_signed(anchor), _signed(_rolling(words.hashes, 1)(at, at + window)), part.column("doc_id").take(take),
                 part.column("uid").take(take), _signed(start)], ["a", "w", "doc_id", "uid", "start"])


def _runs(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the runs that begin where ``first`` is set."""
    return np.add.reduceat(values, np.flatnonzero(first)) if len(values) else values


def parse(row: np.ndarray, start: np.ndarray, windows: np.ndarray, source: np.ndarray, at: np.ndarray,
          window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """The greedy factors (row, start, words, source row, source start) of documents.

    Given are the matches: runs of windows of a row that stand earlier, with their
    source, not overlapping.  From left to right, a factor goes on while the next
    window's source is the next place of the same source; where it ends, the
    windows across its end have their own matches, which begin the next factor
    up to ``window`` - 1 words before that end.
    """
    order = np.lexsort((start, row))
    row, start, windows, source, at = (x[order] for x in (row, start, windows, source, at))
    first = np.ones(len(row), bool)
    step = windows[:-1]
    first[1:] = ~((row[1:] == row[:-1]) & (start[1:] == start[:-1] + step) & (source[1:] == source[:-1])
                  & (at[1:] == at[:-1] + step))
    return row[first], start[first], _runs(first, windows) + window - 1, source[first], at[first]


def spans_of(row: np.ndarray, start: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """The disjoint word spans (row, start, end) that factors cover."""
    end = start + words  # grows with start, since the windows of factors do not overlap
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
    last = np.append(first[1:], True) if len(row) else first
    return row[first], start[first], end[last]


_FACTORS = (
    "uid bigint, n_removed bigint, factors array<struct<start: bigint, words: bigint, source_uid: bigint, "
    "source_start: bigint>>, spans array<struct<start: bigint, end: bigint>>"
)


def _listed(row: np.ndarray, rows: int, **columns: np.ndarray) -> pa.Array:
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    struct = pa.StructArray.from_arrays([_signed(x) for x in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(offsets), struct)


def _parsed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        matches, rows = batch.column("matches"), batch.num_rows
        row = np.repeat(np.arange(rows), matches.value_lengths().to_numpy())
        found = matches.flatten()
        row, start, words, source, at = parse(
            row, *(found.field(c).to_numpy() for c in ("start", "windows", "source_uid", "source_start")), window)
        of, begin, end = spans_of(row, start, words)
        removed = np.bincount(of, end - begin, rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), _signed(removed),
             _listed(row, rows, start=start, words=words, source_uid=source, source_start=at),
             _listed(of, rows, start=begin, end=end)],
            ["uid", "n_removed", "factors", "spans"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans")):
            words, left, at = (text.as_py() or b"").split(), [], 0
            for span in spans.as_py():
                left += words[at:span["start"]]
                at = span["end"]
            out.append(b" ".join(left + words[at:]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), pa.array(out, pa.binary()).cast(pa.string()),
             pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())], ["uid", "kept_text", "kept_sha256"])


def _with_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (one row a uid) with doc_id and text.  Row numbers are broadcast
    to the texts while they are few, so that only wanted texts move."""
    texts = rows.select("uid", "doc_id", "text")
    if wanted.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(wanted.select("uid")), "uid", "left_semi")
    return texts.join(wanted, "uid")


def _first() -> F.Column:
    """The earliest place of a group: null ids last, then doc_id, row, start."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid", "start")
    return F.min(place).alias("first")


def _matched(places: DataFrame, firsts: DataFrame, keys: list[str]) -> DataFrame:
    """The places that are not the first of their key, with that as source."""
    source = firsts.select(*keys, F.col("first.uid").alias("source_uid"), F.col("first.start").alias("source_start"))
    other = (F.col("uid") != F.col("source_uid")) | (F.col("start") != F.col("source_start"))
    return places.join(source, keys).filter(other).select("uid", "start", "windows", "source_uid", "source_start")


def _rows(docs: DataFrame) -> DataFrame:
    named = docs.select(packed(docs, "text"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    schema = StructType([*named.schema.fields, StructField("n_words", LongType()), StructField("sha", StringType())])
    return materialize(named.mapInArrow(_counted, schema).withColumn("uid", F.monotonically_increasing_id()))


def _factors(rows: DataFrame, window: int) -> DataFrame:
    """(uid, n_removed, factors, spans) of the rows that lose words, as a written table."""
    long = rows.filter(F.col("n_words") >= window)
    counted = long.select("text").mapInArrow(lambda b: _anchors(b, window), "a bigint").groupBy("a").agg(
        F.count(F.lit(1)).alias("places"))
    anchors = materialize(counted.filter("places > 1").select("a"))
    found = long.select("uid", "doc_id", "text").mapInArrow(lambda b: _phrases(b, window), _PHRASE)
    places = materialize(found.join(anchors, "a"))
    kinds = materialize(places.groupBy("a", "c").agg(_first(), F.first("windows").alias("windows")))
    several = kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("a")
    edges = materialize(
        kinds.join(several, "a").groupBy(F.col("first.uid").alias("uid"))
        .agg(F.collect_list(F.struct("a", F.col("first.start").alias("start"), "windows")).alias("edges")))
    cut = materialize(
        _with_texts(long, edges).select("uid", "doc_id", "text", "edges")
        .mapInArrow(lambda b: _windows(b, window), _WINDOW_ROW))
    singles = cut.groupBy("a", "w").agg(_first(), F.count(F.lit(1)).alias("n")).filter("n > 1")
    matches = _matched(places, kinds, ["a", "c"]).unionByName(
        _matched(cut.withColumn("windows", F.lit(1).cast("long")), singles, ["a", "w"]))
    by_row = matches.groupBy("uid").agg(
        F.collect_list(F.struct("start", "windows", "source_uid", "source_start")).alias("matches"))
    parsed = materialize(by_row.mapInArrow(lambda b: _parsed(b, window), _FACTORS))
    discard(anchors, places, kinds, edges, cut)
    return parsed


def assess(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns but ``text``),
    ``doc_id``, ``n_words``, ``n_removed``, ``factors`` (start, words, source_doc
    row ``source_uid`` and ``source_start``), ``spans`` (word spans that go), ``uid``,
    ``kept_sha256`` and, if asked for, ``kept_text``: the text as it was where nothing
    goes, else the kept words joined by one space.  Runs jobs when called."""
    rows = _rows(docs)
    parsed = _factors(rows, window)
    sizes = rows.select("uid", "n_words")
    partly = parsed.join(sizes, "uid").filter("n_removed < n_words").select("uid", "spans")
    left = _with_texts(rows, materialize(partly)).select("uid", "text", "spans").mapInArrow(
        _kept, "uid bigint, kept_text string, kept_sha256 string")
    left = left if keep_text else left.drop("kept_text")
    whole = ["row", "doc_id", "uid", "n_words", "sha", *(["text"] if keep_text else [])]
    out = rows.select(*whole).join(parsed, "uid", "left").join(left, "uid", "left")
    gone = F.coalesce(F.col("n_removed"), F.lit(0).cast("long"))
    untouched = gone == 0
    columns = [
        "row", "doc_id", "uid", "n_words", gone.alias("n_removed"), "factors", "spans",
        F.when(untouched, F.col("sha")).otherwise(F.coalesce("kept_sha256", F.lit(_NOTHING))).alias("kept_sha256"),
    ]
    if keep_text:
        columns.append(F.when(untouched, F.col("text")).otherwise(F.coalesce("kept_text", F.lit(""))).alias("kept_text"))
    return out.select(*columns)


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without their repeated passages; documents with no words left go."""
    found = assess(docs, window).filter("n_removed = 0 or n_removed < n_words")
    return unpacked(found, docs, text=F.col("kept_text"))
