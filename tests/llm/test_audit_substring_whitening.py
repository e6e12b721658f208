import hashlib
import random
from itertools import permutations

import numpy as np
import pytest
from conftest import AWKWARD
from kinrank.llm import filter_audit, substring_dedup, whitening
from pyspark.sql import functions as F

# ------------------------------------------------------------------ filter audit

LABELS = "doc_id long, quality int, toxic int"


def brute_audit(rows, labels):
    docs = [(d, s or "", t or "") for d, t, s in rows]
    fails = []
    for d, _, t in docs:
        w = t.encode().split()
        earlier = d is not None and any(e is not None and e < d and u == t for e, _, u in docs)
        upper = sum("A" <= c <= "Z" for c in t)
        bad = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * upper > 5 * len(t), any(c in "#$%&*|" for c in t), earlier)
        fails.append({f for f, x in zip("ABCDE", bad) if x})
    good = [any(q == 1 for i, q, _ in labels if i == d and d is not None) for d, _, _ in docs]
    toxic = [any(x == 1 for i, _, x in labels if i == d and d is not None) for d, _, _ in docs]
    out = {}
    for part in {s for _, s, _ in docs}:
        mine = [i for i, d in enumerate(docs) if d[1] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = set(mine)
            for step, f in enumerate(order, 1):
                hit = {i for i in mine if f in fails[i]}
                gone = hit & alive
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(alive - gone), len(gone), len(hit - alive), sum(fails[i] == {f} for i in mine),
                    sum(good[i] for i in gone), sum(toxic[i] for i in gone)]
                alive -= gone
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


def test_audit_against_brute_force(spark, docs_of):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)] + ["Über", "CAPITALS", "#tag", "a|b"]
    texts = [" ".join(rng.choices(words[: rng.choice([40, 404])], k=rng.choice([5, 49, 50, 90]))) for _ in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(["hot", "hot", "b", None])) for i in range(200)]
    rows += [(None, texts[0], "b"), (7, texts[0], "b"), (500, None, "b"), (501, "", "b"), (501, "", "b")]
    labels = [(i % 150, i % 2, int(i % 7 == 0)) for i in range(300)] + [(None, 1, 1), (3, None, None)]
    df = docs_of(rows, clash=True).withColumn("bits", F.lit("x")).withColumn("part", F.lit("x")).withColumn("copies", F.lit(1))
    said = spark.createDataFrame(labels, LABELS)
    assert audited(filter_audit.audit(df, said)) == brute_audit(rows, labels)


def test_audit_with_a_text_that_most_documents_repeat_and_a_shuffled_lookup(spark, docs_of, monkeypatch):
    monkeypatch.setattr(filter_audit, "COPIES_A_SALT", 10)
    monkeypatch.setattr(filter_audit, "BROADCAST_KEYS", 0)
    rows = [(i, "one copied text" if i % 3 else f"text {i}", "s") for i in range(300)]
    got = audited(filter_audit.audit(docs_of(rows), spark.createDataFrame([], LABELS)))
    assert got == brute_audit(rows, [])
    assert got["s", "EABCD", 1][:2] == (101, 199)


def test_audit_compares_exact_texts(spark, docs_of, monkeypatch):
    """Different texts are told apart even if all hashes collide."""
    monkeypatch.setattr(filter_audit, "row_key", lambda *_: [F.lit(i).cast("long").alias(f"k{i}") for i in (1, 2)])
    rows, copies = filter_audit.failures(docs_of([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")]))
    ids = {r.uid: r.doc_id for r in rows.select("uid", "doc_id").collect()}
    assert sorted(ids[r.uid] for r in copies.collect()) == [2, 4]


def test_audit_empty_table(spark, docs_of):
    assert filter_audit.audit(docs_of([]), spark.createDataFrame([], LABELS)).collect() == []


# ------------------------------------------------------------------ substring dedup


def brute_substrings(rows, window=20):
    """rows in the order that decides; returns (n_words, n_removed, sha) each."""
    seen, out = set(), []
    for text in rows:
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            if g in seen:
                gone.update(range(i, i + window))
            seen.add(g)
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return out


def substrings(df, **kw):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.assess(df, **kw).collect()}


@pytest.mark.parametrize("seed,vocabulary", [(1, 2), (2, 5), (3, 300)])
def test_substrings_against_brute_force(docs_of, seed, vocabulary):
    """Few words make windows overlap, repeat inside a text and share minimisers."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.choice([19, 20, 21, 35, 60, 200]))] for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = [[word() for _ in range(rng.randrange(30))] for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts.insert(rng.randrange(3), p[a:] if rng.random() < 0.5 else p)
        texts.append(" ".join(w for part in parts for w in part))
    texts += [texts[5], "\n".join(texts[6].split()), texts[7].upper()]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want = dict(enumerate(brute_substrings(texts)))
    assert substrings(docs_of(rows, clash=True).repartition(3)) == want


def test_substrings_with_shuffled_lookups(docs_of, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", 0)
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{' '.join(str(rng.random()) for _ in range(30))} {passage} {rng.random()}" for _ in range(80)]
    got = substrings(docs_of(list(enumerate(texts))))
    assert got == dict(enumerate(brute_substrings(texts)))
    assert sum(n for _, n, _ in got.values()) == 60 * 79


def test_factors_name_their_source(docs_of):
    passage = [f"p{i}" for i in range(50)]
    texts = [" ".join(["a", "b", *passage, "c"]), " ".join(["x", *passage, "y", "z"])]
    got = {r.doc_id: r for r in substring_dedup.assess(docs_of(list(enumerate(texts)))).collect()}
    assert got[0].factors is None and got[0].kept_text == texts[0]
    assert [(f.start, f.words, f.source_start) for f in got[1].factors] == [(1, 50, 2)]
    assert got[1].factors[0].source_uid == got[0].uid and got[1].kept_text == "x y z"


def test_parse_checks_across_factor_ends():
    # row 0: windows 0-4 from one source, 5-6 from another: two factors that overlap by 19 words
    matches = [(0, 5, 2, 9, 40), (1, 3, 1, 8, 13), (0, 0, 3, 8, 10), (0, 3, 2, 8, 13)]
    factors = substring_dedup.parse(*map(np.array, zip(*matches)))
    assert list(zip(*factors)) == [(0, 0, 24, 8, 10), (0, 5, 21, 9, 40), (1, 3, 20, 8, 13)]
    assert list(zip(*substring_dedup.spans_of(*factors[:3]))) == [(0, 0, 26), (1, 3, 23)]


def test_phrases_do_not_cross_texts_and_cover_each_window_once():
    rng = random.Random(6)
    texts = [b"", b" \n", b"a", b" ".join(b"%d" % rng.randrange(9) for _ in range(19)), "é\u00a0x\t".encode() * 30]
    texts += [b"\x0b".join(b"w%d" % rng.randrange(3) for _ in range(n)) for n in (20, 21, 150)] + [b"same " * 100]
    offsets = np.cumsum([0, *map(len, texts)])
    words = substring_dedup.words_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert np.diff(words.begins).tolist() == [len(t.split()) for t in texts]
    hash_of = dict(zip([w for t in texts for w in t.split()], words.hashes.tolist()))
    assert [hash_of[w] for t in texts for w in t.split()] == words.hashes.tolist() and len(set(hash_of.values())) == len(hash_of)
    found = substring_dedup.phrases(words)
    seen = [(t, s + i) for t, s, n in zip(found.text, found.start, found.windows) for i in range(n)]
    assert seen == [(t, i) for t, x in enumerate(texts) for i in range(len(x.split()) - 19)]
    alone = [substring_dedup.phrases(substring_dedup.words_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]))) for t in texts]
    assert np.concatenate([p.anchor for p in alone]).tolist() == found.anchor.tolist()


def test_substrings_of_very_long_text(docs_of):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    text = " ".join(base + base[100:20_100])
    assert substrings(docs_of([(1, text), (2, "short")])) == dict(zip((1, 2), brute_substrings([text, "short"])))


def test_substrings_awkward_rows(docs_of):
    long = " ".join(f"q{i}" for i in range(25))
    rows = AWKWARD + [(8, long), (8, long), (None, long)]
    df = docs_of(rows, clash=True)
    got = substring_dedup.assess(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.n_removed) for r in got if r.n_words == 25) == [(False, 0), (False, 25), (True, 25)]
    assert all(r.n_removed == 0 for r in got if r.n_words < 20)
    clean = substring_dedup.clean(df)
    assert clean.columns == df.columns and clean.count() == len(rows) - 2
    assert clean.filter("doc_id = 2").first().text is None
    assert substring_dedup.assess(docs_of([])).collect() == []


# ------------------------------------------------------------------ whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_whitening(vectors, components=16):
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    y = (n * fit - sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:components]
    exact = n * x - sums
    return n, values[order], (exact / n) @ axes[:, order] / np.sqrt(values[order]), (exact**2).sum(1), values.sum()


def whitened(df, k):
    rows = sorted(df.collect(), key=lambda r: (r.vec_id, r.component))
    return np.array([r.whitened for r in rows]).reshape(-1, k), rows


def test_whitening_against_eigh(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((300, 24)) * np.linspace(0.2, 2, 24) + 0.3).astype(np.float32)
    vectors[50:120] = vectors[0]  # copies enter the fit once
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)], VECTORS)
    for name in ("x", "n", "component", "at", "value"):
        df = df.withColumn(name, F.lit("clash"))
    got, rows = whitened(whitening.whiten(df), 16)
    n, values, want, deviations, trace = brute_whitening(vectors)
    signs = np.sign((got * want).sum(0))
    assert np.abs(got - want * signs).max() < 1e-9
    assert {r.n for r in rows} == {n} == {230}
    assert [int(r.deviation) for r in rows[::16]] == deviations.tolist()
    assert np.allclose([r.explained for r in rows[:16]], values / trace, rtol=1e-10)
    assert rows[0].identity_error < 1e-9 and len({r.identity_error for r in rows}) == 1


def test_whitening_finds_repeated_variances_and_leaves_out_none(spark):
    # every corner of a cube: three equal variances, and two dimensions without any
    corners = [[a, b, c, 1.0, 1.0] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(corners)], VECTORS)
    got, rows = whitened(whitening.whiten(df), 3)
    assert got.shape == (8, 3) and np.allclose(got.T @ got / 8, np.eye(3), atol=1e-12)
    assert np.allclose([r.explained for r in rows], 1 / 3) and rows[0].identity_error < 1e-12


def test_whitening_awkward_rows(spark):
    good = [(i, [float(i % 5), float(i % 7), 1.5], 0) for i in range(20)]
    bad = [(100, None, 0), (101, [1.0, None, 2.0], 0), (102, [1.0, float("nan"), 2.0], 0), (103, [1.0, float("inf"), 2.0], 0),
           (104, [], 0), (105, [1.0], 0)]
    df = spark.createDataFrame(good + bad + [(None, [1.0, 1.0, 1.5], 0), (3, [9.0, 9.0, 1.5], 0)], VECTORS)
    rows = whitening.whiten(df).collect()
    assert {r.component for r in rows} == {1, 2} and len(rows) == 2 * 22
    assert {r.vec_id for r in rows} == {*range(20), None}
    assert whitening.whiten(df.filter("false")).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame(bad[:4] + [(1, [], 0)], VECTORS)).collect() == []


def test_deviation_beyond_64_bits_is_exact(spark):
    model = whitening.Whitening(10**9, np.array([10**15, 10**15]), np.eye(2), np.ones(2), 2.0, 0.0)
    rows = spark.createDataFrame([(1, [1_000_064, 999_000])], "vec_id long, x array<long>")
    got = whitening.transform(rows, model).collect()
    assert int(got[0].deviation) == (64 * 10**9) ** 2 + (1000 * 10**9) ** 2
