"""Chat formatting from an event log, in DataFrame functions only.

Events are partitioned by conversation, sorted by sequence and folded by message: a ``message`` or ``edit`` sets the
whole text, ``regenerate`` starts the text anew, a ``delta`` is appended. The final messages of a conversation, in
order of their first event, are rendered with a template that marks turns. Control strings inside texts and roles
are escaped with a backslash (and backslashes doubled), so the rendering can be read back exactly. Texts move once, by
conversation, which folding and rendering share.

Defined results: null text is empty; null role is empty; an unknown or null event is a whole message; equal sequence
numbers are ordered by whole events before deltas, then by text; a null conversation id is a conversation of its own;
an empty log renders nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"

# FIXED VALUES - control strings that are escaped inside texts: the template's own and those of common chat templates.
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

EVENT_KINDS = ("message", "edit", "regenerate", "delta")


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "|[]<>/\\" else c for c in s)


_CONTROL = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in CONTROLS)


def escape(c: Column) -> Column:
    """Double every backslash, then put one behind the first character of every control string."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), _CONTROL, r"$0\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def escape_role(c: Column) -> Column:
    """As ``escape``, and a line feed becomes backslash n, as the header is one line."""
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    pairs = F.split(c, r"\\\\", -1)  # between doubled backslashes
    return F.array_join(F.transform(pairs, lambda x: unescape(F.replace(x, F.lit("\\n"), F.lit("\n")))), "\\")


def event_log(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              pieces: int = 4) -> DataFrame:
    """The log of finished turns as a chat service writes it, one message a row: (conv_id, message_id, seq, event, role,
    text), seq being (turn, step). A user's message, or one of any role but ``assistant``, is sent by its first half and
    then edited to the whole. An assistant's is opened empty and streamed in up to ``pieces`` deltas; of a text with an
    even number of code points the first piece is streamed as a draft and regenerated before that. Folded, the log
    gives the turns again. A null text has no deltas and an empty edit."""
    whole = F.coalesce(F.col(text), F.lit(""))
    size, half = F.length(whole), F.ceil(F.length(whole) / 2).cast("int")
    step = F.greatest(F.ceil(F.length(whole) / pieces), F.lit(1)).cast("int")

    def event(kind: str, body: Column, who: Column = F.lit(None).cast("string")) -> Column:
        return F.struct(F.lit(kind).alias("event"), who.cast("string").alias("role"), body.alias("text"))

    def deltas(upto: Column) -> Column:
        starts = F.when(upto > 0, F.sequence(F.lit(1), upto, step)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: event("delta", F.substr(whole, at, step)))

    opened = F.array(event("message", F.lit(""), F.col(role)))
    draft = F.when((size > 0) & (size % 2 == 0), F.concat(deltas(step), F.array(event("regenerate", F.lit("")))))
    streamed = F.concat(opened, F.coalesce(draft, F.slice(opened, 1, 0)), deltas(size))
    edited = F.array(event("message", F.substr(whole, F.lit(1), half), F.col(role)), event("edit", whole))
    events = F.when(F.col(role) == "assistant", streamed).otherwise(edited)
    log = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                       F.monotonically_increasing_id().alias("message_id"), events.alias("events"))
    log = log.select("conv_id", "turn", "message_id", F.posexplode("events").alias("step", "e"))
    return log.select("conv_id", "message_id", F.struct("turn", "step").alias("seq"), "e.event", "e.role", "e.text")


def fold_events(events: DataFrame, conv: str = "conv_id", seq: str = "seq", message: str = "message_id",
                event: str = "event", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv, message, first_seq, role (the last one given) and the text after all its events."""
    delta = F.coalesce(F.col(event) == "delta", F.lit(False))
    log = F.struct(F.col(seq).alias("seq"), delta.alias("delta"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                   F.col(role).alias("role"))
    by_conv = events.select(F.col(conv).alias("conv_id"), F.col(message).alias("message_id"), log.alias("e"))
    grouped = by_conv.repartition("conv_id").groupBy("conv_id", "message_id").agg(
        F.array_sort(F.collect_list("e")).alias("log"))
    last = F.array_position(F.reverse(F.transform("log", lambda e: ~e["delta"])), True)  # 0: only deltas
    live = F.when(last > 0, F.slice("log", (F.size("log") - last + 1).cast("int"), last.cast("int"))).otherwise(
        F.col("log"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return grouped.select(
        "conv_id", "message_id", F.element_at("log", 1)["seq"].alias("first_seq"),
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss_spans, the [start, end) code points of the texts of
    ``trained`` roles. ``messages`` as ``fold_events`` gives them; equal first_seq are ordered by role and text.
    One conversation is one row, so its messages meet in one task; the window and the grouping share a shuffle."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = messages.select(
        "conv_id", F.struct("first_seq", "role", "text", "message_id").alias("place"),
        head.alias("head"), escape(F.col("text")).alias("body"), F.col("role").isin(*trained).alias("loss"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("turn").cast("bigint")).over(before), F.lit(0)) + F.length("head")
    turns = turns.select("conv_id", "place", "turn", "loss", at.alias("start"), F.length("body").alias("size"))
    done = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("place", "turn", "loss", "start", (F.col("start") + F.col("size")).alias("end")))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"], x["end"]))
    return done.select("conv_id", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
                       spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Turns of a rendering as an array of (role, text), unescaped."""
    parts = F.split(formatted, _quoted(START), -1)

    def turn(p: Column) -> Column:
        header = F.substring_index(p, "\n", 1)
        skip = F.length(header) + 1
        body = F.substr(p, skip + 1, F.length(p) - skip - len(END) - 1)
        return F.struct(unescape_role(header).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(
        spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1,
                                           (s["end"] - s["start"]).cast("int")))), "")
