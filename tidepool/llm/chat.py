"""Chat formatting from event logs (operator 7), in DataFrame functions only.

A log has one row per event: conv_id, turn, message, seq, kind, role, text; message
numbers the messages of a turn, if there are several. Kinds: `message`
and `regenerate` start the turn anew with text (regenerate throws away what was
there), `edit` replaces what was there, `delta` appends. Logs are partitioned by
conversation and turn, sorted by sequence, and folded into final messages; these are
sorted by turn and rendered.

Template: START role SEP text END for each turn. Control strings in roles and texts
are escaped: after every "<" a run of tildes gets one more tilde if it has any or a
"|" follows; so no "<|" is left inside, and reading back takes the tilde off again.

Loss mask: the spans of assistant texts, in code points of the formatted string.

Defined cases: null text or role is empty; events of equal sequence are
folded in order of kind and text, messages of equal turn in order of role and text; a null conv_id is a conversation of its own; turns
sort with null first; an empty log has no conversations; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import written

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>\n"
#: Characters of one streamed delta in the log that from_messages makes.
DELTA = 512
EXTRA_ID = -7
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<~"), F.lit("<~~")), F.lit("<|"), F.lit("<~|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<~|"), F.lit("<|")), F.lit("<~~"), F.lit("<~"))


def from_messages(messages: DataFrame) -> DataFrame:
    """The event log of finished messages (conv_id, turn, role, text) as a server that streams
    and lets users edit and regenerate would have written it. A third of the messages, by
    hash, are streamed: a message without text, then its deltas. A third have a draft that is
    thrown away half-way, then the final text is streamed anew. A third are edited: a draft
    with a delta, then the final text as a whole. Only fold() tells what was meant."""
    src = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    streamed, begin = F.transform(pieces, lambda p: event("delta", p)), F.substring("text", 1, DELTA)
    draft = F.array(event("message", F.lit("(draft) ")), event("delta", begin))
    way = F.pmod(F.xxhash64("role", "text"), F.lit(3))
    log = (
        F.when(way == 0, F.concat(F.array(event("message", F.lit(""))), streamed)).when(way == 1, F.concat(draft, F.array(event("regenerate", F.lit(""))), streamed))
        .otherwise(F.concat(draft, F.array(event("edit", F.col("text")))))
    )
    # rows of one turn, repeated ones too, stay messages of their own
    events = src.withColumn("message", F.monotonically_increasing_id()).select("conv_id", "turn", "message", "role", F.posexplode(log).alias("seq", "e"))
    return events.select("conv_id", "turn", "message", F.col("seq").cast("long").alias("seq"), "e.kind", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages."""
    event = F.struct(F.col("seq"), F.when(F.col("kind") == "delta", 1).otherwise(0).alias("more"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    log = F.array_sort(F.collect_list(event))
    last = F.coalesce(F.array_max(F.transform(F.filter("log", lambda e: e["more"] == 0), lambda e: e["seq"])), F.lit(-(1 << 63)))
    own = F.filter("log", lambda e: e["seq"] >= F.col("last"))
    return (
        events.groupBy("conv_id", "turn", "message").agg(log.alias("log"))
        .withColumn("last", last)
        .select("conv_id", "turn", F.element_at(F.transform("log", lambda e: e["role"]), 1).alias("role"), F.array_join(F.transform(own, lambda e: e["text"]), "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): loss has start and length of each assistant text in
    code points of formatted. Starts are running sums over a conversation's messages."""
    escaped = messages.select("conv_id", "turn", "role", "text", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    ahead = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("r") + F.length("t") + F.lit(len(START) + len(SEP) + len(END))
    start = F.coalesce(F.sum(size).over(ahead), F.lit(0)) + F.lit(len(START) + len(SEP)) + F.length("r")
    placed = escaped.withColumn("start", start.cast("int"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "start", "r", "t")))
    grouped = placed.groupBy("conv_id").agg(turns.alias("p"))
    formatted = F.array_join(F.transform("p", lambda t: F.concat(F.lit(START), t["r"], F.lit(SEP), t["t"], F.lit(END))), "")
    loss = F.transform(F.filter("p", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), F.length(t["t"]).alias("length")))
    return grouped.select("conv_id", formatted.alias("formatted"), loss.alias("loss"))


def numbered(out: DataFrame) -> DataFrame:
    return out.withColumn("c", F.monotonically_increasing_id())


def read_back(out: DataFrame) -> DataFrame:
    """(c, conv_id, n, role, text, masked): the turns of formatted strings, in the order of n, and
    whether the loss mask covers just the text. The string is cut once; where a turn's text
    starts is a running sum, which meets the mask's spans by equality. out: c (a number for
    each conversation), conv_id, formatted, loss."""
    turns = F.split("formatted", r"<\|end\|>\n", -1)
    parts = out.select("c", "conv_id", F.posexplode(F.slice(turns, F.lit(1), F.size(turns) - 1)).alias("n", "part"))
    halves = F.split(F.substring("part", F.lit(len(START) + 1), F.length("part")), r"<\|sep\|>", 2)
    rows = parts.select("c", "conv_id", "n", F.length("part").alias("size"), halves.alias("h"))
    ahead = Window.partitionBy("c").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") + len(END)).over(ahead), F.lit(0)) + F.lit(len(START) + len(SEP)) + F.length(F.col("h")[0])
    rows = rows.select("c", "conv_id", "n", unescape(F.col("h")[0]).alias("role"), unescape(F.col("h")[1]).alias("text"), F.length(F.col("h")[1]).alias("length"), start.cast("int").alias("start"))
    spans = out.select("c", F.explode("loss").alias("s")).select("c", "s.start", "s.length", F.lit(True).alias("_in"))
    met = rows.hint("merge").join(spans.hint("merge"), ["c", "start", "length"], "left")
    return met.select("c", "conv_id", "n", "role", "text", F.coalesce("_in", F.lit(False)).alias("masked"))


def with_extra(conversations: DataFrame) -> DataFrame:
    """conversations and the conversation EXTRA_ID."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    spark = conversations.sparkSession
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    return own.unionByName(extra)


def report(conversations: DataFrame) -> DataFrame:
    """Formats conversations and returns digests of what is read back."""
    out = written(numbered(render(fold(from_messages(with_extra(conversations))))), "formatted")
    turns = F.array_sort(F.collect_list(F.struct("n", "role", "text", "masked")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform(F.filter("turns", lambda t: t["masked"]), lambda t: t["text"]), "")
    per = read_back(out).groupBy("c").agg(F.first("conv_id").alias("conv_id"), turns.alias("turns")).withColumn("masked", masked)
    size = out.select("c", F.length("formatted").cast("long").alias("formatted_chars"))
    return per.join(size.hint("merge"), "c").select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars",
    )
