"""Token-id files: independent zstandard frames with a trailing seek table.

One file holds consecutive documents in doc_id order:

    frame 0 | frame 1 | ... | skippable frame: documents | skippable frame: seek table

* A frame is a complete zstandard frame of token ids (little-endian unsigned
  16 or 32 bit) of whole documents: as many as reach ``FRAME_IDS`` ids.  At 1, the
  default, a frame is one document, and reading one decompresses nothing else.
* The seek table follows the public zstandard seekable format: for every
  frame its compressed size, decompressed size and checksum (the low 32 bits
  of XXH64 of the decompressed bytes), then the number of frames, a
  descriptor and the magic number.  Any zstandard reader skips it.
* The document frame lists (doc_id, is null, frame, ids) per document, as
  compressed little-endian records, so one document needs two range reads.

Writing range-partitions the documents by (doc_id, text hash): ranges are in
order, ties and very frequent ids are split, and one task writes one file
under its own name and moves it into place, so a repeated task replaces its
own file.  Reading is one task per file.  Nothing passes through the driver
but the list of files.

Defined results: a null or empty text has only its end id; a null doc_id
comes first and is kept as null; repeated ids stay apart in hash order; an
empty table writes no file and reads back as no rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinrank.plans.context import partition_count

FRAME_IDS = 1
LEVEL = 3
#: Bytes of text that are encoded at once in a task.
PORTION = 8_000_000
# Fixed values of the public zstandard seekable format.
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_DOCS = 0x184D2A5D
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("ids", "<u4")])
_MANIFEST = "file string, part int, docs bigint, ids bigint"
_READ = "doc_id bigint, part int, position bigint, before bigint, n_tokens bigint, ids_crc32 bigint"


#: Two characters of white space, as ``str.isspace`` has it, in RE2's syntax.
_TWO_WHITE = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
              "{2}")
_LONE_SPACE = re.compile(r"(?<=\S)(?=[ \n]\S)")


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer's own splitting starts a new piece at each space, and puts each
    line break on its own, where these stand between two characters other than white
    space.  So a text is the sequence of its pieces, cut there, and each different
    piece is encoded once per worker: new ones of a portion go through the tokenizer
    together, one a line.  Where white space meets white space, the words around it
    stay one piece.

    Pieces are remembered in two generations.  New ones enter the young one,
    which starts anew when full; a young piece that a later portion meets again
    moves to the old one.  So the many words that occur once in a while never
    push out those that come back, and memory is bounded by both limits.
    """

    def __init__(self, path: str, young: int = 100_000, old: int = 400_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._limits = young, old
        self._line = np.frombuffer(self._ids(["\n"])[0], "<u4")[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _coded(self, pieces: list[str]) -> list[bytes]:
        """The ids of new pieces, each with the white space before it."""
        plain = [x for x in pieces if x.split() == [x.removeprefix("\n")]]
        ids = np.frombuffer(self._ids(["\n".join([x[1:] if x[0] == "\n" else " " + x for x in plain])])[0], "<u4")
        ends = np.flatnonzero(ids == self._line)
        coded = {}
        if len(plain) and len(ends) == len(plain) - 1:
            raw, cuts = ids.tobytes(), (4 * ends).tolist()
            starts, line = [0, *[end + 4 for end in cuts]], self._line.tobytes()
            for piece, start, end in zip(plain, starts, [*cuts, len(raw)]):
                coded[piece] = line + raw[start:end] if piece[0] == "\n" else raw[start:end]
        rest = [x for x in pieces if x not in coded]
        coded |= zip(rest, self._ids([x if x[:1] == "\n" else " " + x for x in rest]))
        return [coded[x] for x in pieces]

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of different ``pieces``, from memory as far as it goes."""
        old, young = self._old, self._young
        known = list(map(old.get, pieces))
        again, fresh = [], []
        for i, ids in enumerate(known):
            if ids is None:
                ids = known[i] = young.pop(pieces[i], None)
                (fresh if ids is None else again).append(i)
        if len(old) + len(again) > self._limits[1]:
            old.clear()
        old |= ((pieces[i], known[i]) for i in again)
        if fresh:
            new = [pieces[i] for i in fresh]
            coded = self._coded(new)
            if len(young) + len(new) > self._limits[0]:
                young.clear()
            young |= zip(new, coded)
            for i, ids in zip(fresh, coded):
                known[i] = ids
        return known

    def __call__(self, texts: pa.Array, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end_id`` after each, and where each text's begin
        (one entry more than texts)."""
        # A line break before each text makes its first word a piece like others; its id makes room for the end id.
        led = pc.binary_join_element_wise("\n", texts, "")
        uneven = np.flatnonzero(pc.match_substring_regex(led, _TWO_WHITE).to_numpy(zero_copy_only=False)).tolist()
        split = pc.split_pattern(pc.replace_substring(led, "\n", " \n"), " ")
        if uneven:
            lists = split.to_pylist()
            for i in uneven:
                lists[i] = ["", *_pieces(texts[i].as_py())]
            split = pa.array(lists, split.type)
        column = split.flatten().dictionary_encode()
        # The first of a text is what stands before its line break: nothing.
        begins = split.offsets.to_numpy() - split.offsets[0].as_py()
        pieces = column.dictionary.to_pylist()
        known = self._known(pieces)
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        index = column.indices.to_numpy()
        counts = sizes[index]
        counts[begins[:-1]] = 0
        for i in uneven:  # the first piece as it stands, without white space before it
            counts[begins[i] + 1] = 0
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(starts[index] - total[:-1], counts) + np.arange(total[-1])]
        offsets = total[begins]
        if not uneven:
            out = np.empty(len(ids), "<u4")
            out[:-1] = ids[1:]
            out[offsets[1:] - 1] = end_id
            return out, offsets
        end, parts, odd = np.array([end_id], "<u4"), [], set(uneven)
        for i in range(len(texts)):
            own = ids[offsets[i]:offsets[i + 1]]
            if i in odd:
                first = self._ids([pieces[index[begins[i] + 1]]])[0]
                parts.append(np.concatenate([np.frombuffer(first, "<u4"), own, end]))
            else:
                parts.append(np.concatenate([own[1:], end]))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _pieces(text: str) -> list[str]:
    """``text`` cut at each space or line break that stands between two characters
    other than white space; a line break stays with the piece after it."""
    return [x.removeprefix(" ") if i else x for i, x in enumerate(_LONE_SPACE.split(text))]


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme of the file system that Spark takes it to be on,
    so that workers and Spark's own writers mean the same place."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class FrameWriter:
    """Writes the file format above to an open binary stream."""

    def __init__(self, out, dtype: str):
        import zstandard

        self._out, self._dtype = out, dtype
        self._zstd = zstandard.ZstdCompressor(level=LEVEL)
        self._open, self._open_ids, self._frames, self._docs = [], 0, [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((doc_id or 0, doc_id is None, len(self._frames), len(ids)))
        self._open.append(ids.astype(self._dtype, copy=False).tobytes())
        self._open_ids += len(ids)
        if self._open_ids >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        import xxhash

        raw = b"".join(self._open)
        packed = self._zstd.compress(raw)
        self._out.write(packed)
        self._frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self._open, self._open_ids = [], 0

    def close(self) -> None:
        if self._open:
            self._flush()
        docs = self._zstd.compress(np.array(self._docs, _DOC).tobytes())
        self._out.write(_skippable(SKIPPABLE_DOCS, docs))
        table = b"".join(struct.pack("<III", *frame) for frame in self._frames)
        footer = struct.pack("<IBI", len(self._frames), CHECKSUM_FLAG, SEEK_MAGIC)
        self._out.write(_skippable(SKIPPABLE_SEEK, table + footer))


class FrameReader:
    """Random access to a file of the format; ``source``: seekable, binary."""

    def __init__(self, source, size: int, dtype: str):
        self._source, self._dtype = source, np.dtype(dtype)
        count, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        start = size - 9 - 12 * count
        frames = np.frombuffer(self._at(start, 12 * count), "<u4").reshape(count, 3)
        self.frames = frames
        self.offsets = np.concatenate([[0], np.cumsum(frames[:, 0], dtype=np.int64)])
        magic, length = struct.unpack("<II", self._at(int(self.offsets[-1]), 8))
        if magic != SKIPPABLE_DOCS:
            raise ValueError("no document list before the seek table")
        self.docs = np.frombuffer(self._unpack(self._at(int(self.offsets[-1]) + 8, length)), _DOC)

    def _at(self, offset: int, length: int) -> bytes:
        self._source.seek(offset)
        return self._source.read(length)

    @staticmethod
    def _unpack(data: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data)

    def frame(self, number: int) -> np.ndarray:
        """The ids of one frame; raises if its checksum does not hold."""
        import xxhash

        size, raw_size, check = (int(x) for x in self.frames[number])
        raw = self._unpack(self._at(int(self.offsets[number]), size))
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {number} is damaged")
        return np.frombuffer(raw, self._dtype)

    def document(self, position: int) -> np.ndarray:
        """The ids of the document at ``position``; reads its frame only."""
        number = int(self.docs["frame"][position])
        first = int(np.searchsorted(self.docs["frame"], number))
        before = int(self.docs["ids"][first:position].sum(dtype=np.int64))
        return self.frame(number)[before:before + int(self.docs["ids"][position])]

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        position = 0
        for number in range(len(self.frames)):
            ids, at = self.frame(number), 0
            while position < len(self.docs) and self.docs["frame"][position] == number:
                doc = self.docs[position]
                yield (None if doc["null"] else int(doc["doc_id"])), ids[at:at + int(doc["ids"])]
                at += int(doc["ids"])
                position += 1


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """(doc_ids, texts) of about ``PORTION`` bytes of text, or one text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        row = 0
        while row < len(ends):
            before = int(ends[row - 1]) if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, before + PORTION, "right")))
            part = batch.slice(row, stop - row)
            yield part.column("doc_id").to_pylist(), part.column("text")
            row = stop


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, dtype: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files under ``folder``, which all
    executors reach; returns the manifest (file, part, docs, ids), written
    beside them.  Runs the job when called."""
    spark, folder = docs.sparkSession, qualified(docs.sparkSession, folder)
    width = dtype or id_type(_vocabulary(tokenizer))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.col("h"), F.col("text")]
    dealt = slim.withColumn("h", F.xxhash64("text")).repartitionByRange(
        partition_count(spark), "doc_id", "h").sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        system, root = _filesystem(folder)
        writer, sink, n_docs, n_ids = None, None, 0, 0
        name = f"part-{part:05d}.tok"
        draft = f"{root}/.{name}-{uuid.uuid4().hex}"
        for doc_ids, texts in _portions(batches):
            if writer is None:
                coder = _encoder(tokenizer)
                sink = system.open_output_stream(draft)
                writer = FrameWriter(sink, width)
            ids, offsets = coder(texts, end_id)
            ids, cuts = ids.astype(width), offsets.tolist()
            for doc_id, start, stop in zip(doc_ids, cuts, cuts[1:]):
                writer.add(doc_id, ids[start:stop])
            n_docs, n_ids = n_docs + len(texts), n_ids + len(ids)
        if writer is not None:
            writer.close()
            sink.close()
            system.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict(
                {"file": [name], "part": pa.array([part], pa.int32()), "docs": [n_docs], "ids": [n_ids]})

    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    dealt.select("doc_id", "text").mapInArrow(encode, _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One per worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def read(spark: SparkSession, folder: str, dtype: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the
    files: frames are decompressed and their checksums verified."""
    folder = qualified(spark, folder)
    manifest = spark.read.parquet(f"{folder}/manifest")
    # one row per file: the running total is over the list of files only
    offset = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("before", F.coalesce(offset, F.lit(0))).select("file", "part", "before")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['file']}") as source:
                    found, at = [], row["before"]
                    for position, (doc_id, ids) in enumerate(FrameReader(source, source.size(), dtype)):
                        found.append((doc_id, row["part"], position, at, len(ids),
                                      zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)],
                        ["doc_id", "part", "position", "before", "n_tokens", "ids_crc32"])

    spread = files.repartition(partition_count(spark), "file")
    return spread.mapInArrow(load, _READ).select(
        "doc_id", F.col("before").alias("start"), "n_tokens", "ids_crc32")


def encode(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the files, then read them back."""
    dtype = id_type(_vocabulary(tokenizer))
    write(docs, folder, tokenizer, end_id, dtype)
    return read(docs.sparkSession, folder, dtype)
