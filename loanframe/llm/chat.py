"""Chat formatting by event sourcing (operator 9, DataFrame functions only).

A conversation log is a table of events

    conv_id, seq, message, kind, role, text

where ``message`` is the place of the message in its conversation and
``kind`` is

* ``delta``: append ``text`` to the message (streamed answers),
* ``edit``: the message now reads ``text``; later deltas append to that,
* ``regenerate``: discard the message and all messages after it, as far as
  they were written before this event; ``text`` (may be empty) starts anew.

``fold`` turns events into final messages, ``render`` writes one training
string a conversation with the spans under the loss mask, ``parse`` reads the
string back.  All three partition by conversation, so Spark shuffles the log
once.  A conversation's rendered string is one value; windows number and
measure its messages before anything is gathered, and only rendered messages
are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Put one backslash more between ``<`` and ``|``: no control string is left in a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """Undo ``escape``."""
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role ends at its line's end, so a backslash is written as ``\\s`` and a line end as ``\\n``."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Undo ``escape_role``: behind every backslash stands s or n, so the two can't be mistaken."""
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\")))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of an event log.

    NULL texts are empty, NULL roles too; an unknown or NULL kind is a delta.
    Events of equal ``seq`` apply in the order of kind, role and text, so the
    result doesn't depend on the order of rows.  An empty log gives no
    messages, a NULL ``conv_id`` is a conversation of its own.  A message's
    role is that of its last event that has one.  Columns other than the six
    are ignored.
    """
    kind = F.when(F.col("kind").isin("edit", "regenerate"), F.col("kind")).otherwise(F.lit("delta"))
    e = events.select("conv_id", "seq", "message", kind.alias("kind"), "role",
                      F.coalesce("text", F.lit("")).alias("text"))
    order = ["seq", "kind", "role", "text"]
    conv = W.partitionBy("conv_id")
    e = e.withColumn("_at", F.row_number().over(conv.orderBy(*order)))
    # what a regeneration of this or an earlier message wiped
    wiped = F.max(F.when(F.col("kind") == "regenerate", F.col("_at"))).over(
        conv.orderBy("message").rangeBetween(W.unboundedPreceding, W.currentRow))
    e = e.withColumn("_wiped", F.coalesce(wiped, F.lit(0))).where("_at >= _wiped")
    reset = F.max(F.when(F.col("kind") != "delta", F.col("_at"))).over(W.partitionBy("conv_id", "message"))
    e = e.withColumn("_reset", F.coalesce(reset, F.lit(0))).where("_at >= _reset")
    parts = F.sort_array(F.collect_list(F.struct("_at", "text")))
    return e.groupBy("conv_id", "message").agg(
        F.max(F.when(F.col("role").isNotNull(), F.struct("_at", "role")))["role"].alias("role"),
        F.concat_ws("", F.transform(parts, lambda p: p["text"])).alias("text"),
    ).withColumn("role", F.coalesce("role", F.lit("")))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row (conv_id, n_turns, formatted, loss_spans) a conversation.

    ``loss_spans`` holds (start, length) in code points of ``formatted``, from
    0, of every text of ``loss_role``: what a model is trained to say.  A
    conversation without such a message has no spans.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    m = messages.select("conv_id", "message", (F.col("role") == loss_role).alias("_loss"), head.alias("_head"),
                        escape(F.col("text")).alias("_body"))
    m = m.withColumn("_piece", F.concat("_head", "_body", F.lit(END + "\n")))
    upto = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, W.currentRow)
    m = m.withColumn("_end", F.sum(F.length("_piece")).over(upto))
    start = F.col("_end") - F.length("_piece") + F.length("_head")
    m = m.withColumn("_span", F.when(F.col("_loss"), F.struct(start.alias("start"),
                                                              F.length("_body").cast("long").alias("length"))))
    pieces = F.sort_array(F.collect_list(F.struct("message", "_piece")))
    return m.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.concat_ws("", F.transform(pieces, lambda p: p["_piece"])).alias("formatted"),
        F.sort_array(F.collect_list("_span")).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a rendered string."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    body = F.transform(pieces, lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(body, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text")))


def masked(formatted: Column, spans: Column) -> Column:
    """Texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(
        F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int"))))


def events_from_turns(conversations: DataFrame) -> DataFrame:
    """Log of a table of turns (conv_id, turn, role, text): one delta a row.

    Every row is a message, repeated rows and equal turns too; equal turns are
    ordered by role and text, NULL turns come first.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").withColumn(
        "seq", F.row_number().over(order).cast("long")).select(
        "conv_id", "seq", F.col("seq").alias("message"), F.lit("delta").alias("kind"), "role", "text")


def digests(rendered: DataFrame) -> DataFrame:
    """What can be read back from rendered conversations."""
    r = rendered.withColumn("turns", parse(F.col("formatted"))).withColumn(
        "loss", F.concat_ws("", masked(F.col("formatted"), F.col("loss_spans"))))
    text = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return r.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
