"""Chat formatting: every assistant turn becomes its own example.

An example holds all turns before its reply as context, and only the reply is
under the loss mask. Turns behind the last reply (or a conversation without
one) go to one more example without a loss, so that the output holds all text.

Template of a turn: ``<turn>role<text>text</turn>``. Inside roles and texts
``\\`` becomes ``\\e`` and ``<`` becomes ``\\l``; hence ``<`` occurs in markers
alone, whatever a text says, and unescaping restores each text exactly.

Null roles, texts: empty. A null conv_id is a conversation of its own. Turns
are in order of turn (nulls first), then role, then text; repeated rows are
repeated turns. Other columns are ignored. Only turns are gathered by
conversation, once; examples are then made one at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let

#: Markers of the template (fixed values of the format).
TURN, TEXT, END = "<turn>", "<text>", "</turn>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, turn_index, text, loss_start, loss_end, is_last); offsets in code points, end exclusive.

    turn_index is the place of the reply among the turns. The mask is empty
    (both offsets are the text's length) in an example without a reply.
    """
    by_conv = (
        turns.select(
            "conv_id",
            F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select(
            "conv_id",
            F.transform("turns", lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))).alias("parts"),
            F.filter(
                F.transform("turns", lambda t, i: F.when((t["role"] == "assistant") | (i == F.size("turns") - 1), F.struct(i.alias("i"), (t["role"] == "assistant").alias("reply")))),
                lambda x: x.isNotNull(),
            ).alias("ends"),
        )
    )
    each = by_conv.select("conv_id", "parts", F.size("parts").alias("n"), F.explode("ends").alias("e")).select(
        "conv_id",
        F.col("e.i").alias("turn_index"),
        F.col("e.reply").alias("reply"),
        (F.col("e.i") == F.col("n") - 1).alias("is_last"),
        F.array_join(F.slice("parts", F.lit(1), F.col("e.i") + 1), "").alias("text"),
        F.length(F.get("parts", F.col("e.i"))).alias("own"),
    )
    # The reply ends before the end marker and starts behind "<turn>assistant<text>".
    head = len(TURN + "assistant" + TEXT)
    return each.select(
        "conv_id",
        "turn_index",
        "text",
        F.when(F.col("reply"), F.length("text") - F.col("own") + head).otherwise(F.length("text")).alias("loss_start"),
        F.when(F.col("reply"), F.length("text") - len(END)).otherwise(F.length("text")).alias("loss_end"),
        "is_last",
    )


def parse_turns(text: Column) -> Column:
    """The turns of a formatted text: an array of (role, text), unescaped."""
    parts = F.split(text, END)  # the last part is empty
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: let(
            F.split(F.substr(p, F.lit(len(TURN) + 1)), TEXT),
            lambda x: F.struct(unescape(F.get(x, F.lit(0))).alias("role"), unescape(F.get(x, F.lit(1))).alias("text")),
        ),
    )


def loss_text(text: Column, start: Column, end: Column) -> Column:
    return unescape(F.substr(text, start + 1, end - start))


def read_back(made: DataFrame) -> DataFrame:
    """One row per conversation, from the examples alone: its turns, its replies in order, the characters formatted."""
    return (
        made.select(
            "conv_id",
            F.length("text").cast("long").alias("chars"),
            F.struct("turn_index", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("reply")).alias("r"),
            F.when(F.col("is_last"), parse_turns(F.col("text"))).alias("turns"),
        )
        .groupBy("conv_id")
        .agg(F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("r")).alias("replies"), F.first("turns", ignorenulls=True).alias("turns"))
        .select("conv_id", "formatted_chars", "turns", F.transform("replies", lambda r: r["reply"]).alias("replies"))
    )
