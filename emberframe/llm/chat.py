"""Chat formatting with prefix-target expansion, in Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BODY, CLOSE = "<s>", "[INST]", "</s>"
#: A control string with any number of escape marks behind its first character.
_PLAIN = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """Put one backslash behind the first character of each control string, escaped ones included."""
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Take that backslash away again."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_conversations(
    turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    trainable: str = "assistant",
) -> DataFrame:
    """One row per conversation: conv_id, formatted, examples.

    A turn becomes ``<s>role[INST]text</s>``. ``examples`` lists, per trainable turn, its position, the
    number of characters before its text (its context is that prefix, all preceding turns included) and the
    characters of its text: the loss mask is that span alone. A turn that nobody replies to stays in
    ``formatted`` and trains nothing.

    Rows are ordered by turn, ties by role and text, nulls first; repeated rows are turns of their
    own. A null role or text is empty. Rows without a conversation id form one conversation. A conversation is one row
    by the contract, so its size is bounded by that of a string.
    """
    row = F.struct(F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("x"))
    marked = turns.groupBy(F.col(conversation).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    pieces = F.transform(
        "rows",
        lambda t, i: F.struct(
            i.alias("position"), (t["r"] == trainable).alias("trained"),
            F.concat(F.lit(OPEN), escape(t["r"]), F.lit(BODY)).alias("head"), escape(t["x"]).alias("body"),
        ),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(
        "cast(array() as array<struct<position:int,context_chars:bigint,target_chars:bigint>>)"
    ).alias("examples"))

    def add(state: Column, piece: Column) -> Column:
        context = state["at"] + F.length(piece["head"])
        target = F.length(piece["body"]).cast("long")
        return F.struct(
            (context + target + len(CLOSE)).cast("long").alias("at"),
            F.when(
                piece["trained"],
                F.array_append(state["examples"], F.struct(
                    piece["position"].cast("int").alias("position"), context.cast("long").alias("context_chars"), target.alias("target_chars"),
                )),
            ).otherwise(state["examples"]).alias("examples"),
        )

    lengths = marked.withColumn("pieces", pieces)
    return lengths.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("pieces", start, add)["examples"].alias("examples"),
    )


def expand_prefix_targets(formatted: DataFrame) -> DataFrame:
    """One row per trainable turn: conv_id, position, context (all before the reply), reply (escaped), context_chars, target_chars.

    The context is a view of the conversation's own string; a query that does not read it does not build it.
    """
    return formatted.select("conv_id", "formatted", F.explode("examples").alias("e")).select(
        "conv_id", F.col("e.position").alias("position"),
        F.substring("formatted", F.lit(1), F.col("e.context_chars").cast("int")).alias("context"),
        F.substring("formatted", (F.col("e.context_chars") + 1).cast("int"), F.col("e.target_chars").cast("int")).alias("reply"),
        F.col("e.context_chars").alias("context_chars"), F.col("e.target_chars").alias("target_chars"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.slice(F.split(formatted, CLOSE, -1), 1, F.size(F.split(formatted, CLOSE, -1)) - 1)

    def one(part: Column) -> Column:
        inner = F.substring(part, F.lit(len(OPEN) + 1), F.length(part))
        halves = F.split(inner, r"\[INST\]", 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(parts, one)
