"""PII: base spans, and terms that reveal protected entities.

1. Base spans (email, ip, card, phone) by the patterns of the contract, per
   kind leftmost and without overlap; a match that fails its check is dropped
   and not tried again.  Positions are code points, end exclusive.
2. Entities are the values of base spans.  Terms (lower-cased runs of letters
   and digits) anywhere in a document that mentions an entity co-occur with
   it.  Over all documents, rows with equal texts counted once, with n(c), n(t)
   and n(c, t) the documents with the entity, the term, and both, the
   disclosure of c by t is

       PMI(c; t) / IC(c) = log(p(c|t) N / n(c)) / log(N / n(c)),

   near 1 where the term hardly occurs without the entity.  p(c|t) is smoothed
   by ``SMOOTH`` documents of the overall rate of c, (n(c,t) + SMOOTH n(c)/N) /
   (n(t) + SMOOTH): few documents are weak evidence, none are left out.
3. In documents that mention the entity, terms that disclose ``GENERALISE`` of
   its information or more become a broader word, from ``REMOVE`` on they go.
   An entity in every document carries no information and has no such terms.

Only DataFrame functions are used.  The patterns start only where a match can
start and use possessive repeats, so long texts cost linear time and no deep
recursion.  Entities and terms are joined by their values, counts are partial
aggregates; a hot entity or term is split by AQE (unique other side).

Defined results: a null text is empty and has no spans; repeated rows are
separate documents; null ids are carried along; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinrank.llm.common import let, packed, row_key, text_of
from kinrank.plans.context import discard, materialize

#: Kinds in the order of the contract, with their patterns (fixed values, made linear).
KINDS = ("email", "ip", "card", "phone")
_START = "(?:\\G|(?<![A-Za-z0-9._%+-]))"
PATTERNS = {
    "email": _START + "[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
TERM_KIND = "term"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TERM = "[\\p{L}\\p{N}]+"

#: A table of repeated texts' keys up to this many rows (24 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_COPIES = 500_000
SMOOTH = 2.0
GENERALISE = 0.8
REMOVE = 0.95


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$")
    count = F.length(_digits(match))
    if kind == "card":
        return count.between(12, 19) & _luhn(_digits(match))
    return count.between(9, 15) if kind == "phone" else F.lit(True)


def _located(text: Column, pattern: str, wanted=None) -> Column:
    """Matches of ``pattern``: array of (start, match), by adding up the
    lengths of the pieces between matches and of the matches.  Appending
    copies the array, so of very many matches only ``wanted`` ones are kept."""
    gaps = F.transform(F.split(text, pattern), lambda g: F.length(g))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        out = F.array_append(acc["out"], F.struct(start.alias("start"), x["match"].alias("match")))
        if wanted is not None:
            out = F.when(wanted(x["match"]), out).otherwise(acc["out"])
        return F.struct((start + F.length(x["match"])).alias("at"), out.alias("out"))

    def located(found: Column) -> Column:
        pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(g.alias("gap"), m.alias("match")))
        empty = F.array().cast("array<struct<start:int,match:string>>")
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), add)["out"]

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def base_spans(text: Column, kind: str) -> Column:
    """Array of (start, order, end, kind, value) of one kind."""
    order = KINDS.index(kind)
    pattern = PATTERNS[kind]
    valid = F.filter(_located(text, pattern), lambda x: _valid(kind, x["match"]))
    spans = F.transform(valid, lambda x: F.struct(
        x["start"].alias("start"), F.lit(order).alias("order"), (x["start"] + F.length(x["match"])).alias("end"),
        F.lit(kind).alias("kind"), F.lower(x["match"]).alias("value")))
    can = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else F.lit(True)
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string>>")
    return F.when(can & text.rlike(pattern), spans).otherwise(none)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    """Number of spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))


def _pairs(found: DataFrame) -> DataFrame:
    """(entity, term, weight): every entity of a document with every term of its whole text."""
    values = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["value"])))
    each = found.select("weight", _terms(F.col("text")).alias("terms"), F.explode(values).alias("entity"))
    return each.select("entity", "weight", F.explode("terms").alias("term"))


def _weighted(df: DataFrame, copies: DataFrame) -> DataFrame:
    """``df`` (with the key of its text) plus ``weight``: one by the number of documents with that text."""
    side = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies
    return df.join(side, ["k1", "k2"], "left").withColumn("weight", 1.0 / F.coalesce("n", F.lit(1)))


def disclosures(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(entity, term, disclosure) at or above ``GENERALISE``, from all ``docs``
    (column ``text``) and their ``rows`` (base spans, key of the text)."""
    distinct = F.round(F.sum("weight")).cast("long")  # copies share a weight of 1, so the sum is whole
    keys = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    total = keys.count()
    copies = materialize(keys.filter("n > 1"))
    found = _weighted(rows.filter(F.size("base") > 0), copies)
    near = _pairs(found).groupBy("entity", "term").agg(distinct.alias("n_ct"))
    seen = found.select("weight", F.explode(F.array_distinct(F.transform(
        "base", lambda s: F.concat_ws(":", s["kind"], s["value"])))).alias("entity")).groupBy("entity").agg(
        distinct.alias("n_c"))
    pairs = materialize(near.join(seen, "entity"))
    # every word of every document is counted before the join: one row per task and term
    everywhere = _weighted(docs.select("text", *row_key(text_of())), copies).select(
        "weight", F.explode(_terms(text_of())).alias("term")).groupBy("term").agg(distinct.alias("n_t"))
    rate = F.col("n_c") / F.lit(float(total))
    given = (F.col("n_ct") + SMOOTH * rate) / (F.col("n_t") + SMOOTH)
    return (
        pairs.join(everywhere, "term").filter(F.col("n_c") < total)
        .select("entity", "term", (F.log2(given / rate) / -F.log2(rate)).alias("disclosure"))
        .filter(F.col("disclosure") >= GENERALISE)
    )


def _broader(term: Column) -> Column:
    return F.when(term.rlike("^[0-9]+$"), "[NUMBER]").when(term.rlike("[0-9]"), "[CODE]").otherwise("[TERM]")


def _term_spans(rows: DataFrame, revealing: DataFrame) -> DataFrame:
    """(uid, extra): spans of revealing terms in documents with their entity."""
    entities = rows.select("uid", F.explode("base").alias("s")).select(
        "uid", F.concat_ws(":", "s.kind", "s.value").alias("entity")).distinct()
    terms = entities.join(revealing, "entity").groupBy("uid", "term").agg(F.max("disclosure").alias("disclosure"))
    per_doc = terms.groupBy("uid").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("flagged"))
    flagged = lambda match: F.map_contains_key("flagged", F.lower(match))
    each = rows.join(per_doc, "uid").select(
        "uid", "base", "flagged", _located(F.col("text"), _TERM, flagged).alias("hits"))
    outside = F.filter(
        "hits", lambda t: ~F.exists("base", lambda s: (s["start"] < t["start"] + F.length(t["match"])) & (t["start"] < s["end"])))
    spans = F.transform(outside, lambda t: F.struct(
        t["start"].alias("start"), F.lit(len(KINDS)).alias("order"), (t["start"] + F.length(t["match"])).alias("end"),
        F.lit(TERM_KIND).alias("kind"),
        F.when(F.element_at("flagged", F.lower(t["match"])) >= REMOVE, "").otherwise(_broader(t["match"])).alias("value")))
    return each.select("uid", spans.alias("extra")).filter(F.size("extra") > 0)


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns but ``text``),
    ``text`` (null where nothing was found), ``base`` and ``spans`` (base and
    term spans: start, order, end, kind, value).  Runs jobs when called."""
    text = text_of()
    step = docs.select(packed(docs, "text"), text.alias("text"))
    base = F.array_sort(F.concat(*[base_spans(F.col("text"), kind) for kind in KINDS]))
    step = step.withColumn("base", base)
    rows = materialize(
        step.select("*", *row_key(F.col("text"))).withColumn("text", F.when(F.size("base") > 0, F.col("text")))
        .withColumn("uid", F.monotonically_increasing_id())
    )
    with_base = rows.filter(F.size("base") > 0)
    revealing = materialize(disclosures(docs, rows))
    extra = _term_spans(with_base, revealing)
    return rows.join(extra, "uid", "left").select(
        "row", "text", "base",
        F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.coalesce(
            "extra", F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string>>")))))
        .alias("spans"),
    )


def rewritten(text: Column, spans: Column) -> Column:
    """``text`` with every base span as ``[KIND]`` and every term span as its
    broader word or nothing; of overlapping spans the first counts."""

    def add(acc: Column, s: Column) -> Column:
        word = F.when(s["kind"] == TERM_KIND, s["value"]).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), word)
        skip = s["start"] < acc["at"]
        return F.struct(
            F.when(skip, acc["at"]).otherwise(s["end"]).alias("at"),
            F.when(skip, acc["out"]).otherwise(F.array_append(acc["out"], piece)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, start, add)
    return let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``clean_text``, for rows with spans, under ``row``; rows
    without spans have a null ``text`` and ``clean_text`` (nothing to change)."""
    found = find(docs)
    return found.withColumn("clean_text", rewritten(F.col("text"), F.col("spans")))
