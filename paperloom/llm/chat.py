"""Chat formatting from event logs: conversations are folded from their events, then rendered with a loss mask.

Everything here is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template. Texts and roles never hold "<" or "[" once escaped.
BEGIN, TURN, END = "<s>", "<|turn|>", "<|end|>"
_ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escaped(text: Column) -> Column:
    """Text in which no control string can stand: backslash, < and [ become two-character codes."""
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Undo ``escaped``."""
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escaped_role(role: Column) -> Column:
    """A role on one line."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, turn, at, role, text)`` of a log ``(conv_id, seq, kind, turn, role, text)``.

    Events of a conversation count in the order of ``seq``, ties by turn, kind, role and text:

    * ``message`` starts a message of its turn; a second one in the same turn is a message of its own;
    * ``delta`` appends to the turn's latest message, and starts one if there is none;
    * ``edit`` replaces the text of the turn's latest message, dropping earlier deltas; it starts one if there is none;
    * ``regenerate`` removes the messages of its turn and of all later turns that came before it.

    A null kind is a message, a null text is empty, a null role is taken from the message's
    first event that has one, else empty. Null ``conv_id``, ``turn`` or ``seq`` are values of their own
    and come first. Repeated events are events; a conversation that ends up empty has no rows.

    A message is summed from its own events, so what is gathered in one place is one message;
    the order of events needs one sort of each conversation.
    """
    named = events.select(
        "conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "turn", "role", F.coalesce("text", F.lit("")).alias("text")
    )
    order = [F.col(c).asc_nulls_first() for c in ("seq", "turn", "kind", "role", "text")]
    numbered = named.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    # The earliest turn that a later regeneration takes away; a null turn counts as lowest.
    later = Window.partitionBy("conv_id").orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    place = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)))
    kept = numbered.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", place)).over(later))
    kept = kept.where((F.col("kind") != "regenerate") & (F.col("cut").isNull() | (place < F.col("cut"))))
    same = Window.partitionBy("conv_id", "turn").orderBy("n")
    starts = (F.col("kind") == "message") | (F.row_number().over(same) == 1)
    owned = kept.withColumn("starts", starts).withColumn("message", F.sum(F.col("starts").cast("int")).over(same.rowsBetween(Window.unboundedPreceding, 0)))
    edited = F.max(F.when(F.col("kind") == "edit", F.col("n"))).over(Window.partitionBy("conv_id", "turn", "message"))
    live = owned.withColumn("edited", F.coalesce(edited, F.lit(0)))
    texts = F.array_sort(F.collect_list(F.when(F.col("n") >= F.col("edited"), F.struct("n", "text"))))
    return live.groupBy("conv_id", "turn", "message").agg(
        F.min("n").alias("at"),
        F.coalesce(F.min_by("role", F.when(F.col("role").isNotNull(), F.col("n"))), F.lit("")).alias("role"),
        F.array_join(F.transform(texts, lambda e: e["text"]), "").alias("text"),
    ).drop("message")


def render_conversations(messages: DataFrame) -> DataFrame:
    """One row a conversation: ``formatted`` text and ``loss``, the spans (start, length in code points) of assistant texts.

    Messages come in the order of turn, then of their first event. A turn is the turn mark,
    the role, a line break, the text and the end mark.
    """
    piece = F.concat(F.lit(TURN), escaped_role(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END))
    rows = messages.select(
        "conv_id", "turn", "at", "role", "text", piece.alias("piece"),
        F.length(escaped("text")).alias("size"), F.length(piece).alias("whole"),
    )
    by_place = F.array_sort(
        F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), "at", "role", "text", "piece", "size", "whole"))
    )
    grouped = rows.groupBy("conv_id").agg(by_place.alias("turns"))
    begun = F.struct(F.lit(len(BEGIN)).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    spans = F.aggregate(
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["size"].alias("size"), t["whole"].alias("whole"))),
        begun,
        lambda acc, t: F.struct(
            (acc["at"] + t["whole"]).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.array_append(acc["loss"], F.struct((acc["at"] + t["whole"] - t["size"] - len(END)).alias("start"), t["size"].alias("length"))),
            ).otherwise(acc["loss"]).alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    formatted = F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: t["piece"]), ""))
    return grouped.select("conv_id", formatted.alias("formatted"), spans.alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """``turns`` (role and text) of formatted conversations, and ``learned``, the unescaped texts under the loss mask.

    The text is cut at its marks once; a turn is learned if its text's span is in the mask.
    """
    pieces = F.split(F.substring(F.col("formatted"), len(BEGIN) + 1, 2**31 - 1), r"<\|turn\|>", -1)
    cut = rendered.select("*", F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("pieces"))
    sizes = F.transform("pieces", lambda p: F.length(p))
    starts = F.aggregate(
        sizes, F.array(F.lit(len(BEGIN))), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n + len(TURN))
    )
    cut = cut.select("*", starts.alias("starts"), F.transform("loss", lambda s: s["start"]).alias("masked"))
    turns = F.transform(
        F.arrays_zip("pieces", F.slice("starts", 1, F.size("pieces")).alias("starts")),
        lambda t: F.struct(
            unescaped_role(F.substring_index(t["pieces"], "\n", 1)).alias("role"),
            unescaped(F.regexp_replace(F.regexp_replace(t["pieces"], r"^[^\n]*\n", ""), r"<\|end\|>\z", "")).alias("text"),
            (t["starts"] + len(TURN) + F.length(F.substring_index(t["pieces"], "\n", 1)) + 1).alias("start"),
        ),
    )
    cut = cut.select("conv_id", "formatted", "masked", turns.alias("turns"))
    learned = F.filter("turns", lambda t: F.array_contains("masked", t["start"]))
    return cut.select("conv_id", "formatted", "turns", F.transform(learned, lambda t: t["text"]).alias("learned"))
