"""Chat formatting by event sourcing, in DataFrame functions only.

A log holds one event a row: `message` gives a text at once, `delta` appends to it, `edit` replaces it, `regenerate`
empties it for new deltas, `delete` takes the message away. Sorted by sequence and folded, a conversation's events
give its final messages in the order in which they first appeared, and these are rendered to one text.

In a rendered text every turn stands between control strings. Inside roles and texts `\\` is written `\\b` and `<|`
is written `<\\p`, so no control string can occur there, and reading them back is exact.

Defined results: null roles and texts are empty; an event that is delivered twice counts once, which its message and
sequence number tell; rows of a table of turns are messages each, also where they repeat; events of one sequence number
fold in the order of their kinds, roles and texts; messages that begin at one number stand in the order of their roles
and texts, those without a number first; a null conversation is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind

START, END = "<|im_start|>", "<|im_end|>\n"
#: Characters of a streamed delta when a finished text is turned into events.
DELTA_CHARS = 4096
#: Fixed order of kinds within one sequence number.
KINDS = ["regenerate", "message", "edit", "delta", "delete"]


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def conversation_events(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The log that would have made these turns: users' texts at once, assistants' by a regeneration and deltas.

    Every row is a message of its own, which the place of the row marks; rows of a turn that repeat can't be told apart,
    so no result depends on the mark.
    """
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0))
    pieces = F.transform(cut, lambda x, i: F.struct((i + 1).alias("n"), F.lit("delta").alias("kind"), x.alias("text")))
    first = F.struct(F.lit(0).alias("n"), F.lit("regenerate").alias("kind"), F.lit("").alias("text"))
    whole = F.array(F.struct(F.lit(0).alias("n"), F.lit("message").alias("kind"), text.alias("text")))
    events = F.when(role == "assistant", F.concat(F.array(first), pieces)).otherwise(whole)
    rows = df.select(F.col(conv_col).alias("conv_id"), F.monotonically_increasing_id().alias("message_id"), F.col(turn_col).alias("turn"), role.alias("role"), events.alias("events"))
    return rows.select("conv_id", "message_id", "turn", "role", F.explode("events").alias("e")).select(
        "conv_id", "message_id", F.struct(F.col("turn").alias("at"), F.col("e.n").alias("n")).alias("seq"), "role", F.col("e.kind").alias("kind"), F.col("e.text").alias("text")
    )


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turns): final messages from (conv_id, message_id, seq, role, kind, text), of any orderable seq.

    One shuffle by conversation serves both groupings. What a message keeps is what follows its last reset, so
    folding takes time in proportion to its events; a conversation is one row of the result in any case.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    event = F.struct("seq", rank.alias("rank"), "role", F.coalesce("text", F.lit("")).alias("text"))
    messages = events.repartition("conv_id").groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(event)).alias("all"))
    # Deliveries of one event are neighbours when sorted.
    messages = messages.select("conv_id", "message_id", F.filter("all", lambda x, i: (i == 0) | (x != F.get("all", i - 1))).alias("log"))
    position = lambda *kinds: F.array_max(F.transform("log", lambda x, i: F.when(x["rank"].isin([KINDS.index(k) + 1 for k in kinds]), i).otherwise(-1)))
    messages = messages.withColumns({"reset": position("regenerate", "message", "edit"), "gone": position("delete")})
    final = F.transform(F.filter("log", lambda x, i: i >= F.col("reset")), lambda x: x["text"])
    turn = F.struct(F.col("log")[0]["seq"].alias("seq"), F.coalesce(F.col("log")[0]["role"], F.lit("")).alias("role"), F.array_join(final, "").alias("text"), F.col("message_id"))
    turns = F.sort_array(F.collect_list(F.when((F.col("gone") < 0) | (F.col("gone") < F.col("reset")), turn)))
    return messages.groupBy("conv_id").agg(F.transform(turns, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def running_sums(sizes: Column) -> Column:
    """The sum of what stands before each entry. Sums run within blocks of the square root's size and then over blocks."""
    zero = F.array(F.lit(0).cast("long"))
    sums = lambda xs, of: F.aggregate(xs, zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + of(x))))
    width = lambda xs: F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1)).cast("int")
    starts = lambda xs, w: F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), w)
    blocks = lambda xs, w: F.transform(starts(xs, w), lambda b: sums(F.slice(xs, b, w), lambda x: x))
    placed = lambda bs, offsets: F.flatten(F.transform(bs, lambda b, i: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: x + F.get(offsets, i))))
    of_blocks = lambda bs: bind(sums(bs, lambda b: F.element_at(b, -1)), lambda offsets: placed(bs, offsets))
    return bind(sizes, lambda xs: bind(width(xs), lambda w: bind(blocks(xs, w), of_blocks)))


def render(df: DataFrame, turns_col: str = "turns", trained_role: str = "assistant") -> DataFrame:
    """df with formatted and loss_spans: for each turn (start, n) in code points of its text, n being 0 for untrained roles."""
    role = lambda x: F.replace(escape(x["role"]), F.lit("\n"), F.lit("\\l"))
    parts = F.transform(turns_col, lambda x: F.struct(F.concat(F.lit(START), role(x), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), (x["role"] == trained_role).alias("loss")))
    df = df.withColumn("__weft_parts", parts)
    df = df.withColumn("__weft_before", running_sums(F.transform("__weft_parts", lambda x: (F.length(x["head"]) + F.length(x["body"]) + len(END)).cast("long"))))
    spans = F.zip_with("__weft_parts", "__weft_before", lambda x, at: F.struct((at + F.length(x["head"])).alias("start"), F.when(x["loss"], F.length(x["body"])).otherwise(0).alias("n")))
    formatted = F.array_join(F.transform("__weft_parts", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    return df.withColumns({"formatted": formatted, "loss_spans": spans}).drop("__weft_parts", "__weft_before")


def pieces(formatted: Column) -> Column:
    """What follows each control string that begins a turn."""
    return F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")


def parse(formatted: Column) -> Column:
    """Turns back from a rendered text."""
    head = lambda x: F.substring_index(x, "\n", 1)
    role = lambda x: unescape(F.replace(head(x), F.lit("\\l"), F.lit("\n")))
    body = lambda x: F.substring(x, F.length(head(x)) + 2, F.length(x) - F.length(head(x)) - 1 - len(END))
    return F.transform(pieces(formatted), lambda x: F.struct(role(x).alias("role"), unescape(body(x)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, read from the rendered text; each span is looked up in its own turn alone."""

    def masked(turns: Column) -> Column:
        ends = running_sums(F.transform(turns, lambda x: (F.length(x) + len(START)).cast("long")))
        inside = lambda x, at, s: F.substring(x, (s["start"] - at - len(START) + 1).cast("int"), s["n"])
        return bind(ends, lambda before: F.transform(turns, lambda x, i: unescape(inside(x, F.get(before, i), F.get(spans, i)))))

    return F.array_join(bind(pieces(formatted), masked), "")
