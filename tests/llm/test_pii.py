import random
import re

from conftest import AWKWARD
from kinrank.llm import pii
from pyspark.sql import functions as F


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def brute(text):
    found = []
    for order, (kind, pattern, valid) in enumerate(RULES):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if valid(m[0])]
    return ",".join(x[2] for x in sorted(found))


def test_base_spans_match_brute_force(docs_of):
    rng = random.Random(11)
    pieces = ["a.b@c.d", "@", ".", "x@y.z_q@r.s", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.002.0.255", "4111 1111 1111 1111",
              "4111-1111-1111-1112", "+1 (722) 555-8977", "+49.30", "+1-----", " ", "\n", "é", "\U0001F600", "0", "7", "-", "+",
              "79927398713", "4222222222222", "a%b+c@d-e.f.g", "(", ")"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14)))) for i in range(400)]
    rows += [(1000, "a" * 60000), (1001, "1" * 60000), (1002, "a@b" + ".c" * 20000), (1003, "+1" + " " * 40000), (1004, None)]
    got = {r.id: r.s for r in pii.find(docs_of(rows, clash=True)).select(
        F.col("row.doc_id").alias("id"), pii.spans_text(F.col("base")).alias("s")).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_revealing_terms_are_found_only_with_their_entity(docs_of):
    rows = [(i, f"common words number{i} and filler text {i * 7} stand here") for i in range(120)]
    rows += [(200 + i, f"page{i} says zebra wrote from boss@corp.example and common words {i}") for i in range(4)]
    rows += [(300, "page nine says zebra wrote alone")]
    df = docs_of(rows)
    found = {r.row.doc_id: r for r in pii.find(df).collect()}
    terms = lambda r: {(s.start, s.end) for s in r.spans if s.kind == "term"}
    for i in range(4):
        text = rows[120 + i][1]
        at = text.index("zebra")
        assert (at, at + 5) in terms(found[200 + i])
        assert not any(text[a:b] == "common" for a, b in terms(found[200 + i]))
    assert not found[300].spans and not found[5].spans
    clean = {r.row.doc_id: r.clean_text for r in pii.sanitise(df).collect()}
    assert "boss@corp" not in clean[200] and "[EMAIL]" in clean[200] and "zebra" not in clean[200]
    # a copied page is one context: no support
    copies = [(i, f"common number{i}") for i in range(120)] + [(200 + i, "zebra boss@corp.example") for i in range(9)]
    assert not any(terms(r) for r in pii.find(docs_of(copies)).collect())


def test_terms_far_from_the_mention_count(docs_of):
    filler = " ".join(["common words stand here"] * 60)
    rows = [(i, f"common words number{i} {filler}") for i in range(120)]
    rows += [(200 + i, f"zebra says {i} {filler} boss@corp.example") for i in range(4)]
    found = {r.row.doc_id: r for r in pii.find(docs_of(rows)).collect()}
    for i in range(4):
        assert (0, 5) in {(s.start, s.end) for s in found[200 + i].spans if s.kind == "term"}
        assert not any(rows[120 + i][1][s.start:s.end] == "common" for s in found[200 + i].spans)


def test_terms_of_rare_and_of_hot_entities(docs_of):
    terms = lambda r: {r.text[s.start:s.end] for s in r.spans if s.kind == "term"}
    # an entity of one document among 400, and one of every second document
    rows = [(i, f"common words number{i}" + (" quagga hot@corp.example" if i % 2 else "")) for i in range(400)]
    rows.append((500, "common okapi from rare@corp.example"))
    found = {r.row.doc_id: r for r in pii.find(docs_of(rows)).collect()}
    assert terms(found[500]) == {"okapi", "from"}
    assert all("quagga" in terms(found[i]) and "common" not in terms(found[i]) for i in range(1, 400, 2))
    # an entity of every document says nothing
    rows = [(i, f"zebra {i} all@corp.example") for i in range(9)]
    assert not any(terms(r) for r in pii.find(docs_of(rows)).collect())


def test_awkward_rows(docs_of):
    assert pii.find(docs_of(AWKWARD, clash=True)).count() == len(AWKWARD)
    assert pii.find(docs_of([])).collect() == []
