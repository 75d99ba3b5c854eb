"""Chat formatting from event logs.

A log holds events of conversations: ``create`` begins a message, ``delta`` appends to it, ``edit``
replaces its text, ``regenerate`` starts its text anew, ``delete`` withdraws it. The log is
partitioned by conversation and sorted by sequence number, the events of a message are folded into
its final text, and the messages are rendered in order of their first event.

Cost: one shuffle by conversation; the window, the fold and the rendering all keep its
partitioning. A rendered conversation is one record, so it is the unit of work; a message's events
are folded by position (last restart, then one join), never by repeated copying.

Template: ``<|start|>role<|text|>text<|end|>`` for each message. Inside roles and texts a backslash
is doubled, and a backslash goes after the first character of each control string; dropping one
backslash before each escaped character gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: Code points of a streamed delta, and the sequence numbers that a message of from_turns has to itself.
DELTA_CHARS, MOST_EVENTS = 1000, 10_000_000
#: The first characters of control strings, of this template and of common ones.
CONTROL = r"<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, seq, role, text) of each live message, from events (conv_id, seq, message, kind, role, text).

    Ties of seq fold in order of kind and text. A null text is empty, a null kind is ``create``. The
    role is that of the first event that has one. A deleted message yields no row; events before the
    first create count as its first text; an empty log gives no row.
    """
    e = F.struct("seq", F.coalesce("kind", F.lit("create")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role")
    grouped = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(e)).alias("log"))
    restart = F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(-1))
    return (
        grouped.withColumn("last", F.greatest(F.array_max(restart), F.lit(0)))
        .where(F.get("log", F.col("last"))["kind"] != "delete")
        .select(
            "conv_id",
            "message",
            F.get("log", F.lit(0))["seq"].alias("seq"),
            F.get(F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull()), F.lit(0)).alias("role"),
            F.array_join(F.transform(F.slice("log", F.col("last") + 1, F.size("log")), lambda x: x["text"]), "").alias("text"),
        )
    )


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, segments, loss_spans) of each conversation, from (conv_id, message, seq, role, text).

    segments are the pieces of formatted in order, with loss true for texts of the trained role;
    loss_spans are the same as code point offsets into formatted, end exclusive. A null role or text
    is empty.
    """
    order = Window.partitionBy("conv_id").orderBy("seq", "message")
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(TEXT))
    parts = messages.select("conv_id", "seq", "message", head.alias("head"), escape(F.col("text")).alias("body"), F.coalesce(F.col("role") == trained_role, F.lit(False)).alias("loss"))
    size = F.length("head") + F.length("body") + len(END)
    placed = parts.withColumn("upto", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stop = F.col("upto") - len(END)
    turn = F.struct("seq", "message", "head", "body", "loss", (stop - F.length("body")).alias("start"), stop.alias("stop"))
    return (
        placed.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .select(
            "conv_id",
            F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
            F.flatten(
                F.transform(
                    "turns",
                    lambda t: F.array(
                        F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
                        F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
                        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
                    ),
                )
            ).alias("segments"),
            F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"))).alias("loss_spans"),
        )
    )


def parse(formatted: Column) -> Column:
    """The (role, text) of each turn, read back from a rendered conversation."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), TEXT, 1)).alias("role"),
            unescape(F.substring_index(p, TEXT, -1)).alias("text"),
        ),
    )


def loss_texts(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, cut from the rendered conversation and unescaped."""
    return F.transform(loss_spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["stop"] - s["start"])))


def from_turns(turns: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The event log of a plain table (conv_id, turn, role, text): for each row, in order of turn, a create and its text streamed in deltas.

    Repeated turns stay apart, in order of role and text. A null or empty text has no delta.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", F.row_number().over(order).cast("long").alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.length("text") - 1, F.lit(delta_chars))).otherwise(F.array().cast("array<int>"))
    delta = F.transform(starts, lambda i: F.struct((F.floor(i / delta_chars) + 1).cast("long").alias("n"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.substr(F.col("text"), i + 1, F.lit(delta_chars)).alias("text")))
    create = F.array(F.struct(F.lit(0).cast("long").alias("n"), F.lit("create").alias("kind"), F.col("role").alias("role"), F.lit("").alias("text")))
    events = rows.select("conv_id", "message", F.explode(F.concat(create, delta)).alias("e"))
    return events.select("conv_id", (F.col("message") * MOST_EVENTS + F.col("e.n")).alias("seq"), "message", "e.kind", "e.role", "e.text")
