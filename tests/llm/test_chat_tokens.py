import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import AWKWARD
from kinrank.llm import chat, token_files
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["\\### Assistant: </turn> ok", "<turn>user\nhi</turn>\n", "<\\turn>", "<\\\\/turn>", "\\", "a\\\n", "</turn>\n</turn>\n",
         "", None, "été \U0001F600", "<turn></turn><turn>", "<\\nl>", "x" * 50000]


def test_round_trip_and_mask(spark):
    rows = []
    for conv in range(12):
        for turn in range(conv):
            rows.append((conv, turn, "assistant" if turn % 2 else "user", NASTY[(conv * 5 + turn) % len(NASTY)]))
    rows += [(50, 0, "user", "only"), (51, 0, "assistant", "a"), (51, 0, "assistant", "a"), (51, None, None, None),
             (None, 1, "odd\nrole<turn>\\", "t"), (None, 2, "assistant", "u")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("parts", F.lit("x")).withColumn("target", F.lit(1))
    got = {r.conv_id: r for r in chat.digest(chat.examples(df)).collect()}
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        row = got[conv]
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert row.loss_chars == len(loss) and row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_each_reply_is_one_example(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a</turn>"), (1, 3, "user", "r"), (1, 4, "assistant", "b")]
    out = chat.examples(spark.createDataFrame(rows, SCHEMA)).orderBy("target").collect()
    assert [r.target for r in out] == [2, 4]
    assert [r.formatted[r.loss_start:r.loss_start + r.loss_length] for r in out] == ["a<\\/turn>", "b"]
    assert out[1].formatted.startswith(out[0].formatted)
    assert chat.examples(spark.createDataFrame([], SCHEMA)).collect() == []


TEXTS = AWKWARD + [(20 + i, t) for i, t in enumerate([
    " lead", "trail ", "a  b", "a   b", "a\n\n b", "a \nb", "it's we'll  x", "x <|endoftext|> y", "ÃÂ \u00a0 z", "1 2 33 444,5.6",
    "a\u3000b c", "tab\tx y\r\n z", "!!! ??? ...", "I'm don't 'tis", "w " * 3000])]


def test_token_files_round_trip(spark, docs_of, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in TEXTS]
    got = token_files.encode(docs_of(rows, clash=True), str(tmp_path / "out"), path).collect()
    want = sorted(
        (-1 if i is None else i, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
        for i, t in rows for ids in [tokenizer.encode(t or "", add_special_tokens=False).ids])
    got = sorted(got, key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert sorted((i, r.n_tokens, r.ids_crc32) for i, r in zip(ids, got)) == want
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()


def test_token_files_of_an_empty_table(docs_of, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_files.encode(docs_of([]), str(tmp_path / "none"), path).collect() == []


def test_frames_are_independent_and_checked(tmp_path, monkeypatch):
    import zstandard

    monkeypatch.setattr(token_files, "FRAME_IDS", 50)
    rng = np.random.default_rng(2)
    docs = [(i if i % 5 else None, rng.integers(0, 60000, rng.integers(1, 90)).astype("<u4")) for i in range(30)]
    file = tmp_path / "f.tok"
    with open(file, "wb") as out:
        writer = token_files.FrameWriter(out, "<u2")
        for doc_id, ids in docs:
            writer.add(doc_id, ids)
        writer.close()
    with open(file, "rb") as source:
        reader = token_files.FrameReader(source, file.stat().st_size, "<u2")
        assert len(reader.frames) > 5
        assert [(d, x.tolist()) for d, x in reader] == [(d, x.tolist()) for d, x in docs]
        assert all(reader.document(i).tolist() == docs[i][1].tolist() for i in (0, 7, 29))
    # any zstandard reader sees the plain ids: the tables are skippable frames
    with open(file, "rb") as source:
        plain = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True).read()
    assert plain == b"".join(x.astype("<u2").tobytes() for _, x in docs)
    damaged = bytearray(file.read_bytes())
    damaged[int(reader.offsets[1]) - 2] ^= 0xFF
    (tmp_path / "bad.tok").write_bytes(bytes(damaged))
    with open(tmp_path / "bad.tok", "rb") as source, pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.FrameReader(source, len(damaged), "<u2").frame(0)
