"""Chat formatting from event logs, with DataFrame functions only.

A log has one event per row: conversation, sequence number, kind, message id,
role, text. The state of a message is a fold over its events in order; it
depends only on the last event that sets the text (`message`, `edit`,
`regenerate`) and the deltas after it, so it is a grouped aggregation, not a
row-by-row replay. Messages are then put in order and rendered.

Rendering: `<|role|>` line, escaped text, `</turn>` line. In roles and texts
`\\`, `<`, `#` and, in roles, line breaks are written as `\\` and a letter, so
no control string can occur inside them and reading back is exact. The loss
mask covers the texts of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order matters: the escape character itself comes first on the way out and last on the way back.
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_ROLE_ESCAPES = (*_ESCAPES, ("\n", "\\n"))
_OPEN, _MIDDLE, _CLOSE = "<|", "|>\n", "\n</turn>\n"
#: Kinds of events that set a message's text; `delta` adds to it, `delete` removes the message.
SETTING = ("message", "edit", "regenerate")


def _replaced(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escaped(c: Column, role: bool = False) -> Column:
    return _replaced(c, _ROLE_ESCAPES if role else _ESCAPES)


def unescaped(c: Column, role: bool = False) -> Column:
    return _replaced(c, tuple((b, a) for a, b in reversed(_ROLE_ESCAPES if role else _ESCAPES)))


def fold_events(events: DataFrame) -> DataFrame:
    """One row per final message: conv_id, at (its place), role, text.

    events has conv_id, seq, kind, message_id, role, text. `message` opens a
    message, `edit` and `regenerate` replace its text, `delta` appends, `delete`
    drops it unless a later event sets it again. Its place is its first event,
    its role the last one given. Events without a message id are messages of
    their own. Unknown kinds are ignored; null texts are empty. Events that
    agree in sequence number are ordered by kind and text. seq may be of any
    type with an order. Other columns of any name are not looked at. Deltas of a
    message are joined before a conversation's messages are brought together, so
    a hot conversation's events are folded by many tasks.
    """
    own = events.filter("message_id is null and coalesce(kind, '') in ('message', 'edit', 'regenerate', 'delta')")
    own = own.select("conv_id", F.col("seq").alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sets, kind = F.col("kind").isin(*SETTING), F.col("kind")
    place = F.struct("seq", F.when(sets, 0).when(kind == "delete", 1).otherwise(2).alias("rank"))
    parts = events.filter(F.col("message_id").isNotNull() & (sets | kind.isin("delta", "delete"))).withColumn("place", place)
    text = F.coalesce("text", F.lit(""))
    last = F.max(F.when(sets | (kind == "delete"), F.struct("place", "kind", text.alias("text")))).alias("last")
    deltas = F.collect_list(F.when(kind == "delta", F.struct("place", text.alias("text")))).alias("deltas")
    role = F.max(F.when(F.col("role").isNotNull(), F.struct("place", "role")))["role"]
    folded = parts.groupBy("conv_id", "message_id").agg(F.min("seq").alias("at"), last, deltas, F.coalesce(role, F.lit("")).alias("role"))
    later = F.filter(F.array_sort("deltas"), lambda d: F.col("last").isNull() | (d["place"] > F.col("last.place")))
    folded = folded.withColumn("later", later).withColumn("base", F.when(F.col("last.kind") != "delete", F.col("last.text")))
    alive = folded.filter(F.col("base").isNotNull() | (F.size("later") > 0))
    done = alive.select("conv_id", "at", "role", F.concat(F.coalesce("base", F.lit("")), F.array_join(F.transform("later", lambda d: d["text"]), "")).alias("text"))
    return own.unionByName(done)


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, n_turns from rows conv_id, at, role, text (ties by role, then text)."""
    turn = F.concat(F.lit(_OPEN), escaped(F.col("role"), True), F.lit(_MIDDLE), escaped(F.col("text")), F.lit(_CLOSE))
    turns = messages.select("conv_id", F.struct("at", "role", "text", turn.alias("turn")).alias("m"))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return ordered.select("conv_id", F.array_join(F.transform("m", lambda x: x["turn"]), "").alias("formatted"), F.size("m").cast("long").alias("n_turns"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array<struct<role, text>>."""
    turns = F.filter(F.split(formatted, "\n</turn>\n"), lambda x: x != "")
    return F.transform(
        turns,
        lambda x: F.struct(
            unescaped(F.substr(F.substring_index(x, _MIDDLE, 1), F.lit(len(_OPEN) + 1)), True).alias("role"),
            unescaped(F.substr(x, F.length(F.substring_index(x, _MIDDLE, 1)) + len(_MIDDLE) + 1)).alias("text"),
        ),
    )


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted for every conversation of an event log (see fold_events).

    Rows with a null conv_id form one conversation. A conversation whose
    messages are all deleted has no row. An empty log gives an empty result.
    One conversation's text must fit a string cell, its messages a task.
    """
    return render(fold_events(events))


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """Rows of whole turns (conv_id, turn, role, text) as the event log that a chat service would have kept of them.

    A user's turn opens with its first half and streams the rest; an
    assistant's streams its first half, is regenerated with that half and
    streams the rest; any other turn opens as a draft that an edit replaces.
    seq is the turn (null last), then the event's place in it. Every row is a
    message of its own, so repeated rows are repeated turns.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, rest = F.left(text, half), F.substr(text, half + 1)
    event = lambda step, kind, x: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), x.alias("said"))
    log = (
        F.when(F.col("role") == "user", F.array(event(0, "message", first), event(1, "delta", rest)))
        .when(F.col("role") == "assistant", F.array(event(0, "message", F.lit("")), event(1, "delta", first), event(2, "regenerate", first), event(3, "delta", rest)))
        .otherwise(F.array(event(0, "message", first), event(1, "edit", text)))
    )
    rows = conversations.select("conv_id", "turn", "role", log.alias("log"), F.monotonically_increasing_id().alias("message_id"))
    rows = rows.select("conv_id", "turn", "role", "message_id", F.explode("log").alias("e"))
    seq = F.struct(F.col("turn").isNull().alias("no_turn"), F.col("turn").alias("turn"), F.col("e.step").alias("step"))
    return rows.select("conv_id", seq.alias("seq"), F.col("e.kind").alias("kind"), "message_id", "role", F.col("e.said").alias("text"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of rendered conversations, from the rendered text alone."""
    turns = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    digests = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"), "formatted_chars")
    return digests.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
