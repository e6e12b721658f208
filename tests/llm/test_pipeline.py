"""The stages on a small corpus with planted cases."""

import inspect
import random

import corpus_pipeline
from kinrank.llm import near_dedup, token_files
from kinrank.llm.wordhash import WordHasher
from pyspark.sql import functions as F


def test_stages_catch_planted_cases_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    bench = [(i, " ".join(prose(30))) for i in range(3)]
    rows = [(i, " ".join(prose(120))) for i in range(60)]  # clean
    original = prose(150)
    near = original[:70] + ["edited"] + original[71:]
    rows += [(100, " ".join(original)), (101, " ".join(original)), (102, " ".join(near))]
    rows += [(200, " ".join(prose(40)) + "\n" + bench[1][1] + "\n" + " ".join(prose(40)))]
    rows += [(300, "too short"), (301, "same words again and " * 30), (302, None)]
    docs = spark.createDataFrame(
        [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept, stages = {}, dict(corpus_pipeline.STAGES)
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in list(stages.items())[:-1]:
        out = stage(spark, current, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in current.collect()}
    clean = set(range(60))
    assert kept["quality_rules"] == clean | {100, 101, 102, 200}
    assert kept["near_duplicates"] == clean | {100, 200}
    assert kept["decontamination"] == clean | {100}
    assert 10 < len(kept["source_mixing"]) < 61 and kept["source_mixing"] <= clean | {100}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == kept["source_mixing"]
    assert out.agg(F.max(F.col("start") + F.col("n_tokens")) == F.sum("n_tokens")).first()[0]
    assert near_dedup.BANDS * 4 == near_dedup.BINS


def test_what_a_worker_keeps_is_bounded():
    """Words, pieces and sets that a Python worker holds, kept well under an executor's share."""
    pieces = inspect.signature(token_files.Encoder).parameters
    assert pieces["young"].default + pieces["old"].default <= 500_000
    hasher = WordHasher()
    hasher(" ".join(f"w{i}" for i in range(150_000)))
    assert len(hasher._known) == 100_000
    assert near_dedup.BLOCK <= 500_000
