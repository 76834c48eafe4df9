"""Chat formatting with typed content parts.

A visitor flattens each turn's parts in order: text is escaped, and image, audio
and document parts become placeholders, recorded as attachments with their
reference and the tokens they expand to. Only DataFrame functions are used.

The template of a turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Every control
string begins with ``<|``; in texts and roles that becomes ``\\l|``, and a backslash
becomes ``\\s``, so the output holds ``<|`` only where the template put it and the
escape can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
# Tokens that a part expands to where it does not say itself.
EXPANDED = {"image": 256, "audio": 128, "document": 512}
PART_TYPE = "struct<type: string, text: string, ref: string, tokens: bigint>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("\\l|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As :func:`escape`; a line break, which ends the role, becomes ``\\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A plain text as the only part of its turn."""
    empty = F.lit(None).cast("string")
    return F.array(
        F.struct(F.lit("text").alias("type"), text.alias("text"), empty.alias("ref"), F.lit(None).cast("bigint").alias("tokens"))
    )


def placeholder(kind: Column) -> Column:
    return F.concat(F.lit("<|"), escape(kind), F.lit("|>"))


def visit(part: Column) -> Column:
    """What a part becomes: a null part or a null text is empty; a part without a type is text."""
    kind = F.coalesce(part["type"], F.lit("text"))
    text = F.coalesce(escape(part["text"]), F.lit(""))
    return F.when(part.isNull(), "").when(kind == "text", text).otherwise(placeholder(kind))


def attachments(parts: Column) -> Column:
    """References of the parts that are not text, in order, with their expanded token counts."""
    known = F.create_map(*(F.lit(x) for pair in EXPANDED.items() for x in pair))
    other = F.filter(parts, lambda p: p.isNotNull() & (F.coalesce(p["type"], F.lit("text")) != "text"))
    return F.transform(
        other,
        lambda p: F.struct(
            p["type"].alias("type"),
            p["ref"].alias("ref"),
            F.coalesce(p["tokens"], F.element_at(known, p["type"]).cast("bigint"), F.lit(0).cast("bigint")).alias("tokens"),
        ),
    )


def format_conversations(
    turns: DataFrame, conv_col: str, turn_col: str, role_col: str, parts_col: str, trained_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation, from rows of turns with an array of typed parts.

    Columns: the conversation's id, ``formatted``, ``n_turns``, ``loss_spans`` (start
    and length in code points, from 0, of the escaped texts of trained roles),
    ``attachments`` in order and ``expanded_tokens``, their sum. Turns are ordered by
    number (null first), then role and content; repeated rows are turns of their
    own. Null roles, texts and part arrays are empty; null ids are one conversation;
    an empty table gives an empty one; other columns are ignored. A conversation is
    one output text, so its rows meet in one task; nothing else does.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART_TYPE}>"))
    flat = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.array_join(F.transform(parts, visit), "").alias("content"),
            attachments(parts).alias("attached"),
        ).alias("row"),
    )
    heard = flat.groupBy("conv").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    shown = heard.select(
        "conv",
        F.size("rows").cast("bigint").alias("n_turns"),
        F.transform(
            "rows",
            lambda r: F.struct(
                F.concat(F.lit(START), escape_role(r["role"]), F.lit("\n")).alias("head"),
                r["content"].alias("content"),
                r["role"].isin(*trained_roles).alias("trained"),
            ),
        ).alias("pieces"),
        F.flatten(F.transform("rows", lambda r: r["attached"])).alias("attachments"),
    )

    def next_span(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["head"])
        span = F.array(F.struct(start.alias("start"), F.length(piece["content"]).alias("length")))
        return F.struct(
            (start + F.length(piece["content"]) + F.lit(len(END))).alias("at"),
            F.when(piece["trained"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))
    return shown.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["content"], F.lit(END))), "").alias("formatted"),
        "n_turns",
        F.aggregate("pieces", first, next_span, lambda s: s["spans"]).alias("loss_spans"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """Roles and texts, read back from the output; placeholders stay as they are."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1_000_000_000)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = piece.substr(F.length(role) + 2, F.length(piece) - F.length(role) - F.lit(1 + len(END)))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["length"]))), "")
