import random

from conftest import AWKWARD
from kinrank.llm import line_dedup, quality
from pyspark.sql import functions as F


def test_base_figures(docs_of):
    text = "a b c d e a b c d e\nx y\nx y\n \n## <z>"
    got = quality.assess(docs_of([(1, text)], clash=True)).collect()[0]
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines) == (16, 19, 4, 1)
    # windows "a b c d e" repeat and cover ten words
    assert got.n_repeat_words == 10 and got.base_failed and not got.kept


def test_overlapping_windows_count_words_once(docs_of):
    got = quality.assess(docs_of([(1, "x " * 50), (2, " ".join(map(str, range(50))))])).collect()
    assert {r.n_repeat_words for r in got} == {50, 0}


def test_frequent_lines_go_and_depleted_documents_are_rejected(docs_of):
    body = lambda i: " ".join(f"word{i}x{j}" for j in range(20))
    rows = [(i, f"Read  our POLICY now\n{body(i)}", "h") for i in range(40)]
    rows.append((100, "read our policy now\nread our policy now\nread our policy now x1\n" + "read our policy now\n" * 8, "h"))
    rows += [(200 + i, "copied page\n" + body(999), "h") for i in range(60)]  # copies are no evidence
    got = {r.row.doc_id: r for r in quality.assess(docs_of(rows), share=0.0).collect()}
    assert all(got[i].kept and got[i].removed_words == 4 for i in range(40))
    assert not got[100].kept
    assert all(got[200 + i].kept and got[200 + i].removed_words == 0 for i in range(60))
    clean = {r.doc_id: r for r in quality.clean(docs_of(rows[:40])).collect()}
    assert clean[3].text == body(3) and clean[3].n_chars == len(body(3))


def test_awkward_rows(docs_of):
    df = docs_of(AWKWARD, clash=True)
    rows = quality.assess(df).collect()
    assert len(rows) == len(AWKWARD) and not any(r.kept for r in rows)
    assert quality.clean(df).columns == df.columns
    assert quality.assess(docs_of([])).collect() == []


def test_line_dedup_keeps_first_and_compares_bytes(docs_of):
    shared = "\n".join(f"shared line number {i} of the passage" for i in range(30))
    rows = [(i, f"own start {i}\n{shared}\nown end {i}") for i in range(5)]
    got = {r.doc_id: r for r in line_dedup.assess(docs_of(rows, clash=True)).collect()}
    assert got[0].removed_lines == 0
    # chunks inside the passage are cut alike wherever it stands
    assert all(got[i].removed_lines >= 15 for i in range(1, 5))
    assert all(got[i].clean_text.startswith(f"own start {i}") for i in range(5))
    assert "\n".join(sorted(got[0].clean_text.split("\n"))) == "\n".join(sorted(rows[0][1].split("\n")))


def test_line_dedup_awkward_rows(docs_of):
    df = docs_of(AWKWARD + [(9, "l1\nl2\nl3\nl4\nl5\nl6"), (9, "l1\nl2\nl3\nl4\nl5\nl6")], clash=True)
    rows = line_dedup.assess(df)
    assert rows.count() == df.count()
    assert rows.filter("doc_id = 2").first().clean_text is None
    assert rows.filter("doc_id = 3").first().clean_text == ""
    assert rows.filter("doc_id = 9").agg(F.sum("removed_chunks")).first()[0] >= 1
    assert line_dedup.clean(df).columns == df.columns
    assert line_dedup.assess(docs_of([])).collect() == []


def brute_passages(rows):
    """Texts without the lines of pairs of lines that occurred before, but for the
    lines of the first occurrence of a pair that occurs again."""
    places = {}
    for key, text in sorted(rows):
        lines = text.split("\n")
        for i, pair in enumerate(zip(lines, lines[1:])):
            if "".join(pair).strip():
                places.setdefault(pair, []).append((key, i))
    gone = {(k, j) for found in places.values() for k, i in found[1:] for j in (i, i + 1)}
    safe = {(found[0][0], j) for found in places.values() if len(found) > 1 for j in (found[0][1], found[0][1] + 1)}
    return {key: "\n".join(x for i, x in enumerate(text.split("\n")) if (key, i) not in gone - safe) for key, text in rows}


def maximal_runs(rows):
    """Every run of two lines or more that stands at several places, with its places,
    found by comparing runs of all lengths (independent of pairs)."""
    found = {}
    for key, text in rows:
        lines = text.split("\n")
        for i in range(len(lines)):
            for j in range(i + 2, len(lines) + 1):
                if "".join(lines[i:j]).strip():
                    found.setdefault(tuple(lines[i:j]), []).append((key, i))
    return {run: places for run, places in found.items() if len(places) > 1}


def test_passages_in_chains_stay_once(docs_of):
    rows = [(1, "w\nx"), (2, "w\nx\ny"), (3, "x\ny")]
    got = {r.doc_id: r.clean_text for r in line_dedup.assess(docs_of(rows)).collect()}
    assert got == {1: "w\nx", 2: "x\ny", 3: ""}


def test_no_repeated_run_is_lost_or_stays_twice(docs_of):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(rng.randrange(1, 12)))) for i in range(80)]
    got = {r.doc_id: r for r in line_dedup.assess(docs_of(rows)).collect()}
    assert {k: r.clean_text for k, r in got.items()} == brute_passages(rows)
    kept = {k: r.clean_text.split("\n") for k, r in got.items()}
    for run, places in maximal_runs(rows).items():
        for pair in zip(run, run[1:]):
            # every pair of its lines still stands somewhere
            assert any(pair in zip(x, x[1:]) for x in kept.values()), (run, places)
    assert sum(map(len, kept.values())) < sum(len(t.split("\n")) for _, t in rows)


def test_short_passages_go_whole_like_brute_force(docs_of):
    rng = random.Random(3)
    shared = [[f"passage {n} line {i}" for i in range(n)] for n in range(2, 9)]
    rows = [(i, "\n".join([f"start {i}", *shared[i % 7], f"middle {i}", *shared[(i + 3) % 7], f"end {i}"])) for i in range(40)]
    rows += [(100 + i, "\n".join(rng.choice(["a", "b", "", "c d", " "]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    got = {r.doc_id: r for r in line_dedup.passages(docs_of(rows, clash=True)).collect()}
    assert {k: r.clean_text for k, r in got.items()} == brute_passages(rows)
    # nothing of a passage of 2 to 8 lines is left after its first occurrence
    assert got[20].clean_text == "start 20\nmiddle 20\nend 20" and got[20].removed_lines == got[20].n_lines - 3
    clean = {r.doc_id: r.text for r in line_dedup.clean(docs_of(rows)).collect()}
    assert clean == brute_passages(rows)
    df = docs_of(AWKWARD, clash=True)
    assert line_dedup.passages(df).count() == len(AWKWARD) and line_dedup.passages(docs_of([])).collect() == []


def test_pages_of_template_and_one_own_line_are_distinct(docs_of):
    template = [f"template line number {j} of every page" for j in range(50)]
    rows = [(i, "\n".join([*template, f"own line {i} of this page"]), "h") for i in range(60)]
    rows += [(100 + i, "\n".join(["copied line a", "copied line b", "own words"]), "h") for i in range(60)]
    got = {r.row.doc_id: r for r in quality.assess(docs_of(rows)).collect()}
    # all fifty lines go, whatever the hashes, and the page is depleted
    assert all(got[i].removed_words == 350 and not got[i].kept for i in range(60))
    assert all(got[100 + i].removed_words == 0 for i in range(60))


def test_hot_host_loses_its_boilerplate_with_production_parameters(docs_of):
    body = lambda i: " ".join(f"word{i}x{j}" for j in range(12))
    rows = [(i, ("share this page\n" if i < 25 else "") + body(i), "hot") for i in range(1500)]
    clean = {r.doc_id: r.text for r in quality.clean(docs_of(rows)).collect()}
    assert clean == {i: body(i) for i in range(1500)}


def test_line_dedup_is_the_same_with_shuffled_lookups(docs_of, monkeypatch):
    rng = random.Random(9)
    rows = [(i, "\n".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(1, 10)))) for i in range(60)]
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    got = {r.doc_id: r.clean_text for r in line_dedup.assess(docs_of(rows)).collect()}
    assert got == brute_passages(rows)


def test_a_hash_of_several_texts_removes_nothing(docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "row_key", lambda *_: [F.lit(i).cast("long").alias(f"k{i}") for i in (1, 2)])
    rows = [(1, "a\nb"), (2, "a\nb"), (3, "c\nd")]
    assert {r.doc_id: r.clean_text for r in line_dedup.assess(docs_of(rows)).collect()} == dict(rows)
