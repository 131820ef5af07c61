"""Chat transcripts rebuilt from event logs, and their rendering with a loss mask.

A log has one row per event: ``conv_id``, ``seq`` (order of the log), ``message`` (position in the
conversation), ``kind``, ``role``, ``text``.  Kinds:

* ``delta`` appends its text to the message (a whole message is one delta),
* ``edit`` replaces the message by its text and takes back everything after it,
* ``regenerate`` empties the message and takes back everything after it; deltas that follow fill it.

Everything is DataFrame code: one exchange by conversation, then sorts and folds inside it.  A
conversation's final text is one value by definition; what leads to it streams through windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import text_of

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Kinds of events that open a message anew.
ANEW = ("edit", "regenerate")


def escape(text: Column) -> Column:
    """No ``<|`` is left: each gets one backslash more inside, so that ``unescape`` takes back just that one."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _header(role: Column) -> Column:
    """A role on one line; its line breaks become a mark of their own."""
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def _role(header: Column) -> Column:
    return unescape(F.replace(header, F.lit(BREAK), F.lit("\n")))


def turns_as_events(turns: DataFrame) -> DataFrame:
    """A log from finished turns (conv_id, turn, role, text): every row is one delta of a message of its own.

    Rows of one conversation and turn are ordered by role and text; repeated rows are separate messages.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text_of("text").alias("text"))
    rows = rows.withColumn("seq", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "seq", F.col("seq").alias("message"), F.lit("delta").alias("kind"), "role", "text")


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) after all edits and regenerations.

    An event is void if a later event of its conversation opens the same or an earlier message anew;
    at equal ``seq`` the order is by message, kind, role and text.  Null kinds count as deltas, null texts
    as empty; the role is that of the first event with one.  Messages left without any event vanish; an
    empty log gives no rows.
    """
    rows = events.select("conv_id", "seq", "message", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", text_of("text").alias("text"))
    order = [F.col(c) for c in ("seq", "message", "kind", "role", "text")]
    later = Window.partitionBy("conv_id").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    anew = F.when(F.col("kind").isin(*ANEW), F.coalesce(F.col("message").cast("long"), F.lit(-(1 << 62))))
    rows = rows.withColumn("cut", F.min(anew).over(later))
    rows = rows.where(F.col("cut").isNull() | (F.coalesce(F.col("message").cast("long"), F.lit(-(1 << 62))) < F.col("cut")))
    parts = F.sort_array(F.collect_list(F.struct("seq", "kind", "text")))
    first_role = F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "role")))
    whole = rows.groupBy("conv_id", "message").agg(parts.alias("parts"), first_role.alias("role"))
    return whole.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, mask.

    Each turn reads ``<|im_start|>role``, a line break, the text, ``<|im_end|>``, a line break.  ``mask``
    lists the texts of the role ``learn``: the turn, where its turn begins, and the text's start and end
    (exclusive), all in code points of ``formatted``.  Messages of equal position are ordered by role and text.
    """
    rows = messages.select("conv_id", "message", F.col("role").alias("said_by"), _header(F.col("role")).alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("turn_text", F.concat(F.lit(START), "head", F.lit("\n"), "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("message", "said_by", "body")
    rows = rows.withColumn("turn", F.row_number().over(order) - 1)
    before = F.coalesce(F.sum(F.length("turn_text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("turn_start", before)
    start = F.col("turn_start") + len(START) + F.length("head") + 1
    span = F.struct("turn", "turn_start", start.alias("start"), (start + F.length("body")).alias("end"))
    made = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "turn_text"))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("said_by") == learn, span))).alias("mask"),
    )
    return made.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn_text"]), "").alias("formatted"), "mask")


def format_chats(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """The log's conversations, folded and rendered: conv_id, formatted, mask.

    All rows of a conversation are dealt out together once.  Rows with a null conv_id form one conversation.
    """
    return render(final_messages(events), learn)


def read_back(chats: DataFrame) -> DataFrame:
    """Turns and learned texts read from the rendered form: conv_id, formatted, mask, turns (role, text), learned."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    split = chats.select("conv_id", "formatted", "mask", F.slice(parts, 1, F.size(parts) - 1).alias("parts"))

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        text = F.substr(part, F.length(head) + 2)
        return F.struct(_role(F.substr(head, F.lit(len(START) + 1))).alias("role"), unescape(text).alias("text"))

    def learned(span: Column) -> Column:
        part = F.get("parts", span["turn"])
        inside = span["start"] - span["turn_start"]
        return unescape(F.substr(part, inside.cast("int") + 1, (span["end"] - span["start"]).cast("int")))

    return split.select("conv_id", "formatted", "mask", F.transform("parts", turn).alias("turns"), F.transform("mask", learned).alias("learned"))
