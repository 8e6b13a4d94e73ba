"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; neighbouring turns of
one role become parts of one block; the blocks are joined to one string:

    <turn>user
    first text<part>second text of the same role</turn>
    <turn>assistant
    ...</turn>

Inside texts and roles ``&`` and ``<`` are written ``&amp;`` and ``&lt;`` (and a
line feed in a role ``&#10;``), so a ``<`` in the output is always a mark of the
template, and the turns can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import before_each, blocks_of, let, span_of

OPEN, PART, CLOSE = "<turn>", "<part>", "</turn>\n"


def _replaced(value: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def escape(text: Column) -> Column:
    return _replaced(text, ("&", "&amp;"), ("<", "&lt;"))


def escape_role(role: Column) -> Column:
    return _replaced(escape(role), ("\n", "&#10;"))


def unescape(text: Column) -> Column:
    return _replaced(text, ("&#10;", "\n"), ("&lt;", "<"), ("&amp;", "&"))


def format_conversations(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``.

    ``loss_spans`` holds start and end (code points of ``formatted``, end
    exclusive) of each text of ``loss_role``, in order; marks are never in it.

    Turns sort by turn number (null first), then role, then text, so ties have
    one order; repeated rows are repeated turns. A null text or role counts as
    empty; a null conversation id is a conversation of its own; an empty table
    gives no rows; further columns are left out.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            escape_role(F.coalesce(F.col(role), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.collect_list("t").alias("turns"))

    def pieces(sorted_turns: Column) -> Column:
        last = F.size(sorted_turns) - 1

        def piece(t: Column, i: Column) -> Column:
            opens = (i == 0) | (F.get(sorted_turns, i - 1)["role"] != t["role"])
            closes = (i == last) | (F.get(sorted_turns, i + 1)["role"] != t["role"])
            return F.struct(
                F.when(opens, F.concat(F.lit(OPEN), t["role"], F.lit("\n"))).otherwise(F.lit(PART)).alias("before"),
                t["text"].alias("text"),
                F.when(closes, F.lit(CLOSE)).otherwise(F.lit("")).alias("after"),
                (t["role"] == F.lit(loss_role)).alias("loss"),
            )

        return F.transform(sorted_turns, piece)

    def joined(parts: Column) -> Column:
        whole = F.array_join(F.transform(parts, lambda p: F.concat(p["before"], p["text"], p["after"])), "")
        steps = F.transform(parts, lambda p: (F.length(p["before"]) + F.length(p["text"]) + F.length(p["after"])).cast("bigint"))

        def all_spans(begins: Column) -> Column:
            def span(p: Column, i: Column) -> Column:
                start = F.get(begins, i) + F.length(p["before"])
                return F.struct(start.alias("start"), (start + F.length(p["text"])).alias("end"), p["loss"].alias("loss"))

            of_loss = F.filter(F.transform(parts, span), lambda s: s["loss"])
            return F.transform(of_loss, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

        spans = let(before_each(steps, lambda a, b: a + b), all_spans)
        return F.struct(whole.alias("formatted"), spans.alias("loss_spans"))

    made = let(F.array_sort("turns"), lambda ts: let(pieces(ts), joined))
    return grouped.select("conv_id", made.alias("made")).select("conv_id", "made.formatted", "made.loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns (array of role and text) written in a formatted conversation."""

    def block(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        body = F.substr(b, F.length(role) + 2, F.length(b) - F.length(role) - 1 - len(CLOSE))
        return F.transform(
            F.split(body, PART, -1), lambda p: F.struct(unescape(role).alias("role"), unescape(p).alias("text"))
        )

    blocks = F.filter(F.split(formatted, OPEN, -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, block))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, unescaped, with nothing between the spans."""
    return let(blocks_of(formatted), lambda b: F.array_join(F.transform(loss_spans, lambda s: unescape(span_of(b, s["start"], s["end"]))), ""))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests, read back from ``format_conversations``' output."""
    back = formatted.select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
