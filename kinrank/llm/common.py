"""Column helpers shared by the training-data operators.

Words are maximal runs outside ``\\x20 \\x09-\\x0D`` (ASCII white space);
lower-casing touches A-Z only.  Every operator first selects the columns it
needs under its own names, so further columns of the caller, whatever they
are called, cannot clash with working columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = "[\\x20\\x09-\\x0D]"
NOT_WHITE = "[^\\x20\\x09-\\x0D]"
_WHITE_CHARS = "\t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """The words of ``text`` in order."""
    return F.array_remove(F.split(F.translate(text, _WHITE_CHARS, " " * len(_WHITE_CHARS)), " "), "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def white_free_length(text: Column) -> Column:
    """Code points of ``text`` outside words' gaps."""
    return F.length(F.translate(text, " " + _WHITE_CHARS, ""))


def md5_long(text: Column) -> Column:
    """The first 60 bits of md5 as a long: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def row_key(*columns: Column) -> list[Column]:
    """Two longs that identify the values of ``columns`` (128 bits)."""
    return [F.xxhash64(F.lit(seed), *columns).alias(f"k{seed}") for seed in (1, 2)]


def packed(df: DataFrame, *apart: str) -> Column:
    """All columns of ``df`` but ``apart`` in one struct ``row``, to be carried
    along where their names cannot clash."""
    rest = [F.col(c) for c in df.columns if c not in apart]
    return (F.struct(*rest) if rest else F.struct(F.lit(0).alias("_none"))).alias("row")


def unpacked(df: DataFrame, like: DataFrame, **apart: Column) -> DataFrame:
    """The columns of ``like`` again, those in ``apart`` as given."""
    return df.select(*[apart[c].alias(c) if c in apart else F.col("row")[c].alias(c) for c in like.columns])


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` cut to ``new_name=old_name`` columns."""
    return df.select(*[F.col(old).alias(new) for new, old in columns.items()])
