import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as further columns of the caller they must not clash.
CLASHING = ("uid", "row", "kept", "h", "k1", "lines", "host", "base", "spans", "shard", "slot", "n_words", "hits", "weight", "topic")


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text) or (doc_id, text, source) pairs as a documents table, with clashing columns on request."""

    def build(rows, clash=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for name in CLASHING:
                from pyspark.sql import functions as F

                df = df.withColumn(name, F.lit("x"))
        return df

    return build


#: Null and empty texts, blanks, null ids, ties and repeated rows.
AWKWARD = [
    (1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, " \t\n "),
    (None, "seven eight nine"), (None, None), (5, "a"), (5, "b\n\nb"), (6, "x" * 5000), (7, "été \U0001F600 z"),
]
