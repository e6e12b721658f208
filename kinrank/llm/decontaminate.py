"""Benchmark decontamination: CGK embedding, bit sampling, exact edit checks.

A document is contaminated by a benchmark item of L words if a window of L
words of it (the whole text, if that is shorter) is at most
``floor(max_edit * L)`` word edits away from the item.

1. Windows.  One whose distance is at most k shares at least
   ``L - q + 1 - k q`` of its word q-grams with the item (q-gram lemma), and at
   least one for the q of ``_gram_size`` (pigeonhole).  Documents are read
   once; windows with fewer q-grams known from any item are left out, which
   loses nothing.
2. Embedding (Chakraborty, Goldenberg, Koucky 2016): a walk of 3 L steps over
   the window; each step writes the current word and a shared random bit of
   (step, word) says whether to move on.  Small edit distance becomes small
   Hamming distance, since walks that drift apart meet again.
3. Bit sampling LSH: ``WALKS`` independent walks, and for each ``SAMPLES``
   signatures of ``SYMBOLS_EACH`` sampled steps.  A window and an item of the
   same length whose signatures meet anywhere are candidates.
4. Candidates are checked by the exact word edit distance.

Everything happens in the task that reads the document: nothing is shuffled
and memory is one Arrow batch.  The benchmark does not grow with the corpus,
but it is not trusted to be small: its size is counted, and it is taken in
blocks of at most ``BLOCK_CHARS`` characters, one pass over the documents for
each block.

Defined results: a null, empty or blank text is clean; null, empty or blank
items match nothing; a null item_id is reported as null; equal items are
reported each under their own id; repeated rows are judged alike.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from kinrank.llm.common import packed, unpacked
from kinrank.llm.wordhash import WordHasher, gram_hashes, mix

MAX_EDIT = 0.2
WALKS = 6
SAMPLES = 12
SYMBOLS_EACH = 3
BLOCK_CHARS = 8_000_000
_BITMAP = 1 << 22
_PAD = np.uint64(0)
_CHUNK = 20_000
_PORTION = 500_000

HIT = StructType([
    StructField("item_id", LongType()), StructField("start_word", IntegerType()),
    StructField("n_words", IntegerType()), StructField("distance", IntegerType()),
])


def _gram_size(length: int, edits: int) -> int:
    """Words of the q-gram that survives ``edits`` edits of ``length`` words."""
    return min(3, -(-(length - edits) // (edits + 1)))


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Levenshtein distance of two word sequences, or ``most + 1`` if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for i, word in enumerate(a, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != word))
        row = np.minimum.accumulate(best - steps) + steps
        if row.min() > most:
            return most + 1
    return int(min(row[-1], most + 1))


def embed(rows: np.ndarray, walk: int) -> np.ndarray:
    """CGK walks of equally long word sequences (n x L): n x 3L symbols."""
    n, length = rows.shape
    padded = np.concatenate([rows, np.full((n, 1), _PAD, np.uint64)], axis=1)
    at, every = np.zeros(n, np.int64), np.arange(n)
    out = np.empty((n, 3 * length), np.uint64)
    for step in range(3 * length):
        now = padded[every, at]
        out[:, step] = now
        bit = mix(now + np.uint64(((walk << 20) + step + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), length)
    return out


def signatures(rows: np.ndarray) -> np.ndarray:
    """n x (WALKS * SAMPLES) LSH signatures of equally long word sequences."""
    length = rows.shape[1]
    found = []
    for walk in range(WALKS):
        symbols = embed(rows, walk)
        # a walk has read its words after about 2L steps; later steps are padding
        steps = np.random.default_rng(1000 * walk + length).integers(0, 2 * length, (SAMPLES, SYMBOLS_EACH))
        for sample, chosen in enumerate(steps):
            total = np.full(len(rows), np.uint64(walk * SAMPLES + sample + 1), np.uint64)
            for step in chosen:
                total = mix(total * np.uint64(0x100000001B3) + symbols[:, step])
            found.append(total)
    return np.stack(found, axis=1)


class Benchmark:
    """Items of one block, grouped by their number of words."""

    def __init__(self, items: list[tuple[int | None, str | None]], max_edit: float):
        hasher, by_length = WordHasher(), defaultdict(list)
        for item_id, text in items:
            found = hasher(text)
            if len(found):
                by_length[len(found)].append((item_id, found))
        self.groups, grams = [], defaultdict(lambda: defaultdict(set))
        for g, (length, group) in enumerate(sorted(by_length.items())):
            edits = int(max_edit * length)
            size = _gram_size(length, edits)
            for _, found in group:
                for gram in gram_hashes(found, size).tolist():
                    grams[size][gram].add(g)
            buckets = defaultdict(set)
            for number, row in enumerate(signatures(np.stack([found for _, found in group])).tolist()):
                for column, value in enumerate(row):
                    buckets[column, value].add(number)
            least = max(1, length - size + 1 - edits * size)
            self.groups.append((length, edits, size, least, group, dict(buckets)))
        #: q -> (known q-grams, sorted; the groups of each; which places of a bitmap they take)
        self.grams = {}
        for size, found in grams.items():
            known = np.array(sorted(found), np.uint64)
            taken = np.zeros(_BITMAP, bool)
            taken[(known % np.uint64(_BITMAP)).astype(np.intp)] = True
            self.grams[size] = known, [sorted(found[x]) for x in known.tolist()], taken

    def search(self, texts: list[np.ndarray]) -> list[list[tuple]]:
        """For each text (as word hashes) its hits (item_id, start word, window
        words, distance): the best window of each item found."""
        best: list[dict] = [{} for _ in texts]
        ends = np.cumsum([len(x) for x in texts])
        every = np.concatenate(texts) if texts else np.empty(0, np.uint64)
        seeds = defaultdict(lambda: defaultdict(list))  # group -> text -> starts of known q-grams
        for size, (known, groups, taken) in self.grams.items():
            found = gram_hashes(every, size)
            places = np.flatnonzero(taken[(found % np.uint64(_BITMAP)).astype(np.intp)])
            ranks = np.minimum(np.searchsorted(known, found[places]), len(known) - 1)
            real = known[ranks] == found[places]
            owners = np.searchsorted(ends, places, side="right")
            for place, rank, owner in zip(places[real].tolist(), ranks[real].tolist(), owners[real].tolist()):
                if place + size <= ends[owner]:
                    for g in groups[rank]:
                        seeds[g][owner].append(place - int(ends[owner]) + len(texts[owner]))
        for g, (length, edits, size, least, group, buckets) in enumerate(self.groups):
            windows = []
            for owner, starts in seeds[g].items():
                if len(texts[owner]) < length:
                    if length - len(texts[owner]) <= edits:
                        for number in range(len(group)):
                            self._check(best[owner], g, number, texts[owner], 0)
                elif len(starts) >= least:
                    windows += [(owner, at) for at in _dense(starts, least, length - size + 1,
                                                             len(texts[owner]) - length)]
            for i in range(0, len(windows), _CHUNK):
                self._collide(best, g, texts, windows[i:i + _CHUNK])
        return [[found[key] for key in sorted(found)] for found in best]

    def _collide(self, best: list[dict], g: int, texts: list[np.ndarray], windows: list[tuple[int, int]]) -> None:
        length, buckets = self.groups[g][0], self.groups[g][5]
        rows = np.stack([texts[owner][at:at + length] for owner, at in windows])
        for (owner, at), row, marks in zip(windows, rows, signatures(rows).tolist()):
            near = set()
            for column, value in enumerate(marks):
                near |= buckets.get((column, value), set())
            for number in near:
                self._check(best[owner], g, number, row, at)

    def _check(self, best: dict, g: int, number: int, window: np.ndarray, at: int) -> None:
        item_id, item = self.groups[g][4][number]
        before = best.get((g, number))
        most = self.groups[g][1] if before is None else before[3] - 1
        if most >= 0 and (distance := edit_distance(item, window, most)) <= most:
            best[g, number] = (item_id, at, len(window), distance)


def _dense(starts: list[int], least: int, span: int, last: int) -> list[int]:
    """Window starts up to ``last`` whose next ``span`` q-grams hold ``least`` of ``starts``."""
    places = np.array(starts)
    low = max(0, places[0] - span + 1)
    tried = np.arange(low, min(int(places[-1]), last) + 1)
    counts = np.searchsorted(places, tried + span) - np.searchsorted(places, tried)
    return tried[counts >= least].tolist()


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded size."""
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-chars // BLOCK_CHARS)
    for block in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == block)
        yield [(row.id, row.text) for row in part.collect()]


def _portions(texts: pa.Array, hasher: WordHasher) -> Iterator[list[np.ndarray]]:
    """The texts as word hashes, about ``_PORTION`` words at a time."""
    some, size = [], 0
    for text in texts:
        some.append(hasher(text.as_py()))
        size += len(some[-1])
        if size >= _PORTION:
            yield some
            some, size = [], 0
    yield some


def flag(docs: DataFrame, items: list[tuple], max_edit: float = MAX_EDIT, text: str = "text") -> DataFrame:
    """``docs`` plus ``hits``: an array of HIT, empty for clean rows."""
    schema = StructType([*docs.schema.fields, StructField("hits", ArrayType(HIT))])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), *[(f, pa.int32()) for f in HIT.names[1:]]]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hasher = Benchmark(items, max_edit), WordHasher()
        for batch in batches:
            found = []
            for some in _portions(batch.column(text), hasher):
                found += known.search(some)
            hits = pa.array([[dict(zip(HIT.names, hit)) for hit in row] for row in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, hits], [*batch.schema.names, "hits"])

    return docs.mapInArrow(search, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance): one row for each
    document and item found in it, with the best window."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark, item_id, item_text):
        part = flag(slim, items, max_edit).select("doc_id", F.inline("hits"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        empty = slim.limit(0).withColumn("hits", F.lit(None).cast(ArrayType(HIT)))
        out = empty.select("doc_id", F.inline("hits"))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT) -> DataFrame:
    """The documents in which no item is found, columns as given."""
    rows = docs.select(packed(docs, "text"), F.col("text").cast("string").alias("text"))
    for items in _blocks(benchmark, "item_id", "text"):
        rows = flag(rows, items, max_edit).filter(F.size("hits") == 0).drop("hits")
    return unpacked(rows, docs, text=F.col("text"))
