"""Chat formatting with typed content parts, on DataFrame functions only.

A turn holds ordered parts ``struct<type, text, ref, units>``. The visitor keeps text parts
(escaped), and replaces image, audio and document parts by numbered placeholders; the k-th
attachment of a conversation is ``<|type:k|>`` and stands for ``units`` tokens. References
and token counts come back as an array beside the text.

Template of a turn: ``<|start|>role<|sep|>body<|end|>``. Inside roles and texts, ``\\``, ``<``
and ``[`` become ``\\e``, ``\\l`` and ``\\b``, so no control string can occur in them, and
the way back is exact. The loss mask is an array of (start, length) in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
MEDIA = ("image", "audio", "document")
PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\e"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """One text part; null text is an empty text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("units")))


def format_chat(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss, attachments, n_turns, expanded_tokens) per conversation.

    ``turns`` has conv_id, turn, role and parts. Turns are ordered by turn (null first), then
    role, then content, so ties have one order; repeated rows are repeated turns. Null role
    is an empty role, null parts no parts, an unknown part type is treated as a document.
    Null conversation ids form one conversation. An empty table gives no rows. A conversation
    is one output text, so its size is bounded by what a single row may hold.
    """
    parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    kind = lambda p: F.when(p["type"].isin("text", *MEDIA), p["type"]).otherwise(F.lit("document"))
    rows = turns.select(F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.withColumn("parts", F.transform("parts", lambda p: F.struct(kind(p).alias("type"), p["text"].alias("text"), p["ref"].alias("ref"), F.coalesce(p["units"], F.lit(0)).alias("units"))))
    # Placeholders stand without numbers first; control strings cannot occur in escaped text, so splitting finds exactly them.
    body = F.array_join(F.transform("parts", lambda p: F.when(p["type"] == "text", escape(p["text"])).otherwise(F.concat(F.lit("<|"), p["type"], F.lit(":|>")))), "")
    media = F.filter(F.transform("parts", lambda p, j: F.struct(j.alias("part_no"), p["type"].alias("type"), p["ref"].alias("ref"), p["units"].alias("tokens"))), lambda p: p["type"] != "text")
    rows = rows.withColumn("body", body).withColumn("media", media)

    # What stands before a turn is a running sum over its conversation, in one pass over the sorted turns.
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("turn_no", F.row_number().over(order) - 1).withColumn("number", F.coalesce(F.sum(F.size("media")).over(before), F.lit(0)).cast("int"))
    pieces = F.split("body", rf"(?<=<\|(?:{'|'.join(MEDIA)}):)(?=\|>)", -1)
    numbered = F.array_join(F.transform(pieces, lambda x, k: F.when(k < F.size("media"), F.concat(x, (F.col("number") + k).cast("string"))).otherwise(x)), "")
    rows = rows.withColumn("body", numbered).withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)))
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.withColumn("start", (F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")).cast("int"))
    held = F.transform("media", lambda a, k: F.struct((F.col("number") + k).alias("number"), F.col("turn_no").alias("turn_no"), a["part_no"].alias("part_no"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    turn = F.struct("turn_no", "start", F.length("body").alias("length"), F.col("role").isin(*loss_roles).alias("loss"), F.concat("head", "body", F.lit(END)).alias("text"), held.alias("media"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    attachments = F.flatten(F.transform("t", lambda x: x["media"]))
    return out.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["text"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss"),
        attachments.alias("attachments"),
        F.size("t").cast("long").alias("n_turns"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def parse_chat(formatted: Column) -> Column:
    """array<struct<role, text>> read back from formatted text, unescaped."""
    turns = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    halves = F.transform(turns, lambda x: F.split(F.substring(x, len(START) + 1, 2147483647), r"<\|sep\|>", 2))
    return F.transform(halves, lambda h: F.struct(unescape(F.get(h, F.lit(0))).alias("role"), unescape(F.get(h, F.lit(1))).alias("text")))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped and in order."""
    return unescape(F.array_join(F.transform(loss, lambda s: F.substring(formatted, s["start"] + 1, s["length"])), ""))
