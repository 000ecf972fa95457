"""Chat formatting from an event log, in DataFrame functions only.

The log holds what a chat service stores while it runs, one row an event:
``conv_id, seq, kind, message, turn, role, text``.  Kinds:

* ``open``        the message begins; carries its ``turn`` and ``role``
* ``regenerate``  what the message holds is thrown away; later deltas fill it anew
* ``edit``        the message is ``text`` from here on
* ``delta``       a streamed piece, appended to the message

Method.  The log is partitioned by conversation and message, a message's
events are sorted by sequence and folded: the last edit or regeneration is
where its text starts, and the pieces from there on are joined.  The final
messages of a conversation, in order of their turns, are rendered with the
template, ``PART`` turns to a row (a *part*), so that no row and no task holds
a conversation of any length; a conversation's text is its parts end to end.
A message's text is one value, and its events meet in one row.

Template: ``<turn ROLE>TEXT</turn>`` and a line feed for every message.  In
roles and texts ``&``, ``<`` and ``>`` become ``&amp;``, ``&lt;`` and ``&gt;``,
so neither mark can occur in them, and ``unescape`` gives the text back.
``loss`` lists the spans (start and length in code points of the part's text)
of the assistant's texts, without marks.

Cases: null texts and roles are empty; a null ``conv_id`` is a conversation of
its own; messages whose ``open`` is missing have no turn and an empty role and
come first; equal turns are ordered by ``message``; events that differ but
share ``seq`` are ordered by kind as listed above, then by text; an event
delivered again, equal in all columns, counts once; events of other kinds and
with a null kind change nothing but let their message exist; an empty log
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 64  # turns rendered into one row
LOSS_ROLE = "assistant"
KINDS = ("open", "regenerate", "edit", "delta")
LOG_COLUMNS = ("conv_id", "seq", "kind", "message", "turn", "role", "text")
HEAD, HEAD_END, TAIL = "<turn ", ">", "</turn>\n"


def escape(text: Column) -> Column:
    """Text without the characters that marks are made of."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def unescape(text: Column) -> Column:
    for sign, name in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def final_messages(log: DataFrame) -> DataFrame:
    """conv_id, message, turn, role, text: the log folded message by message."""
    kind = F.lower("kind")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.coalesce(kind, F.lit("")))
    events = log.select(*LOG_COLUMNS).withColumns({"order": order, "text": F.coalesce("text", F.lit(""))})
    opened = F.min(F.when(F.col("order") == 1, F.struct("seq", "turn", F.coalesce("role", F.lit("")).alias("role")))).alias("opened")
    # where the text starts: the last event that throws away what was there
    start = F.max(F.when(F.col("order").isin(2, 3), F.struct("seq", "order", "text"))).alias("start")
    pieces = F.collect_list(F.when(F.col("order").isin(3, 4), F.struct("seq", "order", "text"))).alias("pieces")
    folded = events.groupBy("conv_id", "message").agg(opened, start, pieces)
    from_start = lambda e: F.col("start").isNull() | (e >= F.col("start"))
    live = folded.withColumn("pieces", F.array_sort(F.filter("pieces", from_start)))
    again = lambda e, i: (i > 0) & e.eqNullSafe(F.get("pieces", i - 1))
    text = F.array_join(F.transform(F.filter("pieces", lambda e, i: ~again(e, i)), lambda e: e["text"]), "")
    return live.select("conv_id", "message", F.col("opened.turn").alias("turn"), F.coalesce("opened.role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, turns: int = PART) -> DataFrame:
    """conv_id, part, n_turns, formatted, loss: ``turns`` turns to a row."""
    part = F.floor(F.col("turn") / turns).alias("part")
    head = F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(HEAD_END))
    shown = messages.withColumns({"head": head, "body": escape(F.col("text"))})
    turn = F.struct("turn", "message", "role", "head", "body")
    parts = shown.groupBy("conv_id", part).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TAIL)))
    step = lambda acc, t: F.struct(
        (acc["at"] + F.char_length(t["head"]) + F.char_length(t["body"]) + len(TAIL)).alias("at"),
        F.when(
            t["role"] == LOSS_ROLE,
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.char_length(t["head"])).alias("start"), F.char_length(t["body"]).alias("length")))),
        )
        .otherwise(acc["spans"])
        .alias("spans"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<struct<start:int,length:int>>").alias("spans"))
    return parts.select(
        "conv_id",
        "part",
        F.size("turns").alias("n_turns"),
        F.array_join(lines, "").alias("formatted"),
        F.aggregate("turns", zero, step, lambda acc: acc["spans"]).alias("loss"),
    )


def format_log(log: DataFrame, turns: int = PART) -> DataFrame:
    """The formatted parts of every conversation of an event log."""
    return render(final_messages(log), turns)


def read_turns(formatted: Column) -> Column:
    """Roles and texts read back from the text of a part."""
    marked = F.split(formatted, TAIL)  # the last piece is what follows the last mark
    one = lambda x: F.struct(
        unescape(F.substr(F.substring_index(x, HEAD_END, 1), F.lit(len(HEAD) + 1))).alias("role"),
        unescape(F.substr(x, F.char_length(F.substring_index(x, HEAD_END, 1)) + 2)).alias("text"),
    )
    return F.transform(F.slice(marked, 1, F.size(marked) - 1), one)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))


def digest(parts: DataFrame) -> DataFrame:
    """One row a conversation, all of it read back from the formatted parts.  A
    digest over a whole conversation needs its text in one value; the parts do not."""
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = parts.select(
        "conv_id",
        F.struct("part", F.array_join(turns, "").alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss")), "").alias("loss")).alias("read"),
        F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("read")).alias("read"))
    joined = lambda name: F.array_join(F.transform("read", lambda r: r[name]), "")
    whole = whole.withColumns({"turns": joined("turns"), "loss": joined("loss")})
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
