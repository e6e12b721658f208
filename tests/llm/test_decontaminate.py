import random

from conftest import AWKWARD
from kinrank.llm import decontaminate
from kinrank.llm.wordhash import WordHasher


def brute(docs, items, max_edit=0.2):
    hasher, found = WordHasher(), set()
    for doc_id, text in docs:
        words = hasher(text)
        for item_id, item_text in items:
            item = hasher(item_text)
            if len(item) == 0 or len(words) == 0:
                continue
            most = int(max_edit * len(item))
            starts = range(max(1, len(words) - len(item) + 1))
            if any(decontaminate.edit_distance(item, words[s:s + len(item)], most) <= most for s in starts):
                found.add((doc_id, item_id))
    return found


def edited(rng, words, count, vocabulary):
    out = list(words)
    for _ in range(count):
        at = rng.randrange(len(out))
        kind = rng.choice("sid")
        if kind == "s":
            out[at] = rng.choice(vocabulary)
        elif kind == "i":
            out.insert(at, rng.choice(vocabulary))
        else:
            del out[at]
    return out


def test_recall_and_precision_against_brute_force(spark, docs_of):
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "in"] * 20 + [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([12, 20, 35, 60])))) for i in range(20)]
    docs = []
    for i in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 150))]
        if i % 2:
            item = items[rng.randrange(20)][1].split()
            passage = edited(rng, item, rng.randrange(0, len(item) // 7 + 1), vocabulary)
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        docs.append((i, " ".join(body).title() if i % 3 == 0 else " ".join(body)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs_of(docs), benchmark).collect()}
    truth = brute(docs, items)
    assert len(truth) > 40 and got <= truth
    assert len(got) >= 0.95 * len(truth)


def test_short_items_blocks_and_awkward_rows(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 8)
    items = [(1, "a"), (2, None), (3, ""), (4, "one two three four five"), (None, "seven eight nine"), (5, "A")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(AWKWARD, clash=True)
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.contamination(df, benchmark).collect()), key=str)
    assert got == sorted([(1, 4), (1, 4), (5, 1), (5, 5), (None, None)], key=str)
    clean = decontaminate.clean(df, benchmark)
    assert clean.columns == df.columns
    assert clean.count() == len(AWKWARD) - 4


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs_of(AWKWARD), none).collect() == []
    assert decontaminate.clean(docs_of(AWKWARD), none).count() == len(AWKWARD)
    one = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(docs_of([]), one).collect() == []


def test_edit_distance():
    import numpy as np

    word = lambda s: np.array([ord(c) for c in s], np.uint64)
    assert decontaminate.edit_distance(word("kitten"), word("sitting"), 5) == 3
    assert decontaminate.edit_distance(word("kitten"), word("sitting"), 2) == 3
    assert decontaminate.edit_distance(word(""), word("ab"), 2) == 2
