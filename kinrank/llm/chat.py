"""Chat formatting: one training example per assistant reply.

Template of a turn: ``<turn>ROLE`` newline ``TEXT</turn>`` newline.  Inside
texts and roles every backslash is doubled and a backslash is put after the
``<`` of ``<turn>`` and ``</turn>``, so the control strings stand only where
the template wrote them; a newline in a role becomes ``<\\nl>``.  After ``<``
a single backslash never comes from a text (those are doubled), so replacing
in the opposite order restores every text exactly.

Prefix-target expansion: each assistant turn becomes an example of all turns
before it plus itself; the loss mask [loss_start, loss_start + loss_length)
covers the escaped reply and nothing else.  Turns after the last assistant
turn (and conversations without one) would be lost, so they give one example
more with an empty mask (``target`` null).

Only DataFrame functions are used.  A conversation is one training document
and is assembled in one row; its examples repeat earlier turns by definition.

Defined results: null texts and roles count as empty; turns are ordered by
(turn, role, text) with null turns first, so ties and repeated rows have a
fixed order and are all kept; rows with a null conv_id form one conversation;
an empty table gives no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinrank.llm.common import text_of

OPEN, CLOSE, TARGET_ROLE = "<turn>", "</turn>", "assistant"
_CLOSE_LINE = CLOSE + "\n"


def _replace(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


_TEXT = [("\\", "\\\\"), (CLOSE, "<\\/turn>"), (OPEN, "<\\turn>")]
_ROLE = [*_TEXT, ("\n", "<\\nl>")]


def escape(text: Column) -> Column:
    return _replace(text, _TEXT)


def unescape(text: Column) -> Column:
    return _replace(text, [(new, old) for old, new in reversed(_TEXT)])


def escape_role(role: Column) -> Column:
    return _replace(role, _ROLE)


def unescape_role(role: Column) -> Column:
    return _replace(role, [(new, old) for old, new in reversed(_ROLE)])


def examples(conversations: DataFrame, target_role: str = TARGET_ROLE) -> DataFrame:
    """(conv_id, target, formatted, loss_start, loss_length): ``target`` is the
    0-based position of the trained turn, null for the untrained rest;
    offsets are 0-based code points of ``formatted``."""
    turn = F.struct(F.col("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    convs = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"))
    parts = convs.select("conv_id", "turns", F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), escape(t["text"]).alias("body"))).alias("parts"))
    asked = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (F.get("turns", i)["role"] == target_role) | (i == F.size("turns") - 1),
    )
    each = parts.select("conv_id", "turns", "parts", F.explode(asked).alias("at"))
    whole = lambda p: F.concat(p["head"], p["body"], F.lit(_CLOSE_LINE))
    prefix = F.array_join(F.transform(F.slice("parts", 1, F.col("at")), whole), "")
    now = F.get("parts", F.col("at"))
    trained = F.get("turns", F.col("at"))["role"] == target_role
    built = each.select(
        "conv_id", F.when(trained, F.col("at")).alias("target"), prefix.alias("_prefix"), now.alias("_now"),
    )
    start = F.length("_prefix") + F.length("_now.head")
    return built.select(
        "conv_id", "target",
        F.concat(F.col("_prefix"), whole(F.col("_now"))).alias("formatted"),
        F.when(F.col("target").isNotNull(), start).otherwise(0).alias("loss_start"),
        F.when(F.col("target").isNotNull(), F.length("_now.body")).otherwise(0).alias("loss_length"),
    )


def trained_text(example: Column | str = "formatted") -> Column:
    """The text under the loss mask of an example, unescaped."""
    text = F.col(example) if isinstance(example, str) else example
    return unescape(F.substring(text, F.col("loss_start") + 1, F.col("loss_length")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    pieces = F.split(formatted, "\\Q" + _CLOSE_LINE + "\\E")
    turns = F.slice(pieces, 1, F.size(pieces) - 1)  # the string ends with the mark
    return F.transform(turns, lambda p: F.struct(
        unescape_role(F.substring_index(F.substring(p, F.lit(len(OPEN) + 1), F.length(p)), "\n", 1)).alias("role"),
        unescape(F.substring(p, F.locate("\n", p) + 1, F.length(p))).alias("text"),
    ))


def digest(output: DataFrame) -> DataFrame:
    """Per conversation what its examples say: number and digest of the turns
    (from the longest example), the trained text, all formatted characters."""
    slim = output.select(
        "conv_id", F.length("formatted").cast("long").alias("size"), "target", "formatted",
        trained_text().alias("trained"),
    )
    found = slim.groupBy("conv_id").agg(
        F.max_by("formatted", "size").alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "trained")))).alias("loss"),
        F.sum("size").alias("formatted_chars"),
    )
    turns = parse(F.col("whole"))
    loss = F.array_join(F.transform("loss", lambda x: x["trained"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted_chars").select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
