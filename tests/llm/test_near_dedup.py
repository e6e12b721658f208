import random

import numpy as np
from conftest import AWKWARD, CLASHING
from kinrank.llm import near_dedup
from kinrank.llm.graph import components
from kinrank.llm.wordhash import WordHasher, shingle_set


def brute(rows, words, pct=80):
    """component_id per row by comparing every pair."""
    sets = [set(shingle_set(WordHasher()(t), words).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= pct * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def test_matches_all_pairs(spark, docs_of, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.choice([1, 4, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900 + i, t) for i, (_, t) in enumerate(AWKWARD)]
    monkeypatch.setattr(near_dedup, "BLOCK", 100)  # several blocks per bucket
    got = near_dedup.assign(docs_of(rows, clash=True), words=4).select("doc_id", "n_shingles", "component_id")
    key = lambda r: (r[0], r[1], str(r[2]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, 4), key=key)


def test_awkward_rows_and_columns(docs_of):
    df = docs_of(AWKWARD, clash=True)
    rows = near_dedup.assign(df).collect()
    assert len(rows) == len(AWKWARD)
    assert sorted(r.component_id for r in rows if r.doc_id == 1) == [1, 1]
    assert all(not r.kept for r in rows if r.doc_id is None)
    kept = near_dedup.dedup(df)
    assert kept.columns == df.columns and set(CLASHING) <= set(kept.columns)


def test_empty_table(docs_of):
    assert near_dedup.assign(docs_of([])).collect() == []


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    assert len(near_dedup.sketch(rng.integers(0, 2**63, 1).astype(np.uint64))) == near_dedup.BINS
    errors = []
    for _ in range(40):
        both = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        a, b = both[:270], both[30:]
        same = (near_dedup.sketch(a) == near_dedup.sketch(b)).mean()
        errors.append(same - len(np.intersect1d(a, b)) / len(both))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_lookup_in_several_ranges(spark, docs_of, monkeypatch):
    """Every wanted row is found once, in however many ranges the row numbers are cut."""
    rows = docs_of([(i, f"text {i}") for i in range(60)]).repartition(6).selectExpr(
        "monotonically_increasing_id() AS uid", "1L AS n_shingles", "array(1) AS sketch", "text")
    rows = near_dedup.materialize(rows)
    wanted = rows.filter("text LIKE '%3%'").select("uid")
    expected = sorted(r.text for r in rows.filter("text LIKE '%3%'").collect())
    for limit in (1, 4, 1000):
        monkeypatch.setattr(near_dedup, "WANTED", limit)
        assert sorted(r.text for r in near_dedup._looked_up(rows, wanted).collect()) == expected
    assert near_dedup._looked_up(rows, wanted.filter("false")).collect() == []
