"""Chat formatting from event logs, in DataFrame functions only.

A conversation is logged as events (conv_id, seq, message, kind, role, text): ``start``
opens a message, ``delta`` adds text to it, ``edit`` puts text in place of what it held,
``regenerate`` empties it. Folding gives the final messages, which are rendered as

    <turn ROLE>TEXT</turn>

with a line feed behind each turn.
Inside roles and texts a backslash is written ``\\s``, ``<`` is written ``\\l`` and (roles)
``>`` is written ``\\g``, so no control string can stand there and reading gives the texts back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    """Inverse of :func:`escaped`: there a backslash always begins one of the written forms."""
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(text, F.lit("\\s"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the final messages.

    A message stands where its first event stands; its role is that of its first event
    with one, else empty. Events before its last edit or regeneration are dropped before
    anything is gathered. An event that the log repeats (same conversation, message and
    seq) counts once. Null texts are empty; a null conv_id is a conversation of its own.
    """
    message = Window.partitionBy("conv_id", "message")
    reset = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).over(message)
    rows = events.select("conv_id", "message", "seq", "kind", "role", "text").withColumn("reset", reset).withColumn(
        "place", F.min("seq").over(message)).withColumn(
        "who", F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).over(message))
    rows = rows.where("reset is null or seq >= reset")
    text = F.when(F.col("kind").isin("delta", "edit"), F.coalesce("text", F.lit(""))).otherwise("")
    parts = F.sort_array(F.collect_list(F.struct("seq", text.alias("text"))))
    rows = rows.groupBy("conv_id", "message").agg(
        F.min("place").alias("place"), F.coalesce(F.min("who.role"), F.lit("")).alias("role"), parts.alias("parts"))
    once = F.filter("parts", lambda e, i: (i == 0) | ~e["seq"].eqNullSafe(F.get("parts", i - 1)["seq"]))
    return rows.select("conv_id", "place", "role", F.array_join(F.transform(once, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of messages (conv_id, place, role, text) by place.

    ``loss_spans`` lists (start, end) in code points of ``formatted``, end exclusive: the
    written texts of the role ``assistant``.
    """
    role = F.replace(escaped(F.col("role")), F.lit(">"), F.lit("\\g"))
    turn = messages.select(
        "conv_id", "place", F.concat(F.lit("<turn "), role, F.lit(">")).alias("head"),
        escaped(F.col("text")).alias("body"), (F.col("role") == LEARNED).alias("learned"))
    rows = turn.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "head", "body", "learned"))).alias("t"))
    formatted = F.array_join(F.transform("t", lambda m: F.concat(m["head"], m["body"], F.lit("</turn>\n"))), "")
    sizes = F.transform("t", lambda m: F.struct(
        F.char_length(m["head"]).alias("head"), F.char_length(m["body"]).alias("body"), m["learned"].alias("learned")))
    spans = F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, m: F.struct(
            (a["at"] + m["head"] + m["body"] + 8).alias("at"),
            F.when(m["learned"], F.concat(a["spans"], F.array(F.struct(
                (a["at"] + m["head"]).alias("start"), (a["at"] + m["head"] + m["body"]).alias("end"))))
            ).otherwise(a["spans"]).alias("spans")), lambda a: a["spans"])
    return rows.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a rendered conversation holds."""
    turn = F.lit(r"<turn ([^>]*)>([^<]*)</turn>\n")
    roles, texts = F.regexp_extract_all(formatted, turn, F.lit(1)), F.regexp_extract_all(formatted, turn, F.lit(2))
    return F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda m: F.struct(
        unescaped(m["role"]).alias("role"), unescaped(m["text"]).alias("text")))


def learned_texts(formatted: Column, spans: Column) -> Column:
    """What stands under the loss mask of a rendered conversation, a text for each span, unescaped."""
    return F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def event_log(conversations: DataFrame) -> DataFrame:
    """A log whose fold is the given rows (conv_id, turn, role, text), as a chat service writes it.

    Texts arrive in pieces; answers of the assistant are begun, thrown away and generated
    anew, other texts are typed and then edited. Rows that repeat a turn are messages of
    their own, in the order of role and text. Null texts are empty, null roles too.
    """
    text, size = F.coalesce("text", F.lit("")), F.char_length(F.coalesce("text", F.lit("")))
    third = F.ceil(size / 3).cast("int")
    piece = [F.substring(text, F.lit(1), third), F.substring(text, third + 1, third),
             F.substring(text, 2 * third + 1, third)]
    same = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn(
        "message", F.row_number().over(same).cast("long"))

    def events(*kinds):
        return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), t.alias("text"))
                         for i, (k, t) in enumerate(kinds)])

    none = F.lit(None).cast("string")
    learned = events(("start", none), ("delta", piece[0]), ("regenerate", none),
                     *[("delta", p) for p in piece])
    other = events(("start", none), ("delta", piece[1]), ("edit", piece[0]), ("delta", F.concat(*piece[1:])))
    rows = rows.withColumn("e", F.explode(F.when(F.col("role") == LEARNED, learned).otherwise(other)))
    return rows.select("conv_id", "message", (8 * F.col("message") + F.col("e.i")).alias("seq"), "e.kind",
                       F.when(F.col("e.kind") == "start", F.coalesce("role", F.lit(""))).alias("role"), "e.text")
