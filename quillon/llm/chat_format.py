"""Chat formatting with typed content parts.

A turn's content is a text, or a list of parts with a ``type``: text, image, audio or
document. A visitor flattens the parts of a conversation in order: a text becomes itself,
escaped; an attachment becomes a numbered placeholder, and its reference, place and number
of tokens after expansion are recorded. A turn is written as::

    <|im_start|>ROLE newline PARTS<|im_end|> newline

Escapes are reversible: a backslash is doubled, and one is put inside each ``<|``, before a
``|`` that a part after the first begins with (the part before may end in ``<``), and
before a line end in a role. No text can make a mark that way, and dropping each backslash
before its neighbour gives the text back. The loss mask are spans of code points, one for
each text part of an assistant turn.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = ("image", "audio", "document")
LEARNED_ROLE = "assistant"
PART = "struct<type:string,text:string,ref:string,tokens:int>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _parts(content: Column, kind: T.DataType) -> Column:
    if not isinstance(kind, T.ArrayType):
        one = F.struct(F.lit("text").alias("type"), F.coalesce(content.cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))
        return F.array(one)
    return F.filter(F.coalesce(content.cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text") -> DataFrame:
    """Format each conversation: ``conv_id, formatted, loss_spans, attachments, expanded_tokens``.

    ``loss_spans`` are ``start, length`` in code points, in order. ``attachments`` are
    ``number, turn, type, ref, tokens, start`` and ``expanded_tokens`` sums their tokens.

    Rows stand by turn, nulls first, equal turns by role and content. Null texts, parts and
    lists are empty, a null role is the empty role, null tokens count 0. A part of another
    type is taken as text. Null conversation ids are one conversation. Equal rows are turns
    each. Other columns are ignored; an empty table gives no conversation. A conversation is
    one value by its nature and is put together in one task.
    """
    kind = turns.schema[content_col].dataType
    cut = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), _parts(F.col(content_col), kind).alias("parts"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "parts")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    attached = F.filter("parts", lambda p: F.coalesce(p["type"].isin(*PLACEHOLDERS), F.lit(False)))
    numbered = cut.withColumn("place", F.row_number().over(order)).withColumn("number", F.coalesce(F.sum(F.size(attached)).over(so_far), F.lit(0)))

    def visit(p: Column, i: Column) -> Column:
        is_attachment = F.coalesce(p["type"].isin(*PLACEHOLDERS), F.lit(False))
        ahead = F.size(F.filter(F.slice("parts", 1, i), lambda q: F.coalesce(q["type"].isin(*PLACEHOLDERS), F.lit(False))))
        number = (F.col("number") + ahead).cast("long")
        mark = F.concat(F.lit("<|"), p["type"], F.lit(":"), number.cast("string"), F.lit("|>"))
        text = escape(F.coalesce(p["text"], F.lit("")))
        text = F.when((i > 0) & text.startswith("|"), F.concat(F.lit("\\"), text)).otherwise(text)
        return F.struct(F.when(is_attachment, mark).otherwise(text).alias("out"), is_attachment.alias("attached"), number.alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens"))

    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    visited = numbered.withColumn("flat", F.transform("parts", visit)).withColumn("head", head)
    written = visited.withColumn("piece", F.concat("head", F.array_join(F.transform("flat", lambda x: x["out"]), ""), F.lit(END + "\n")))
    based = written.withColumn("base", F.coalesce(F.sum(F.length("piece")).over(so_far), F.lit(0)) + F.length("head"))

    def start(i: Column) -> Column:
        return F.col("base") + F.aggregate(F.slice("flat", 1, i), F.lit(0).cast("long"), lambda a, x: a + F.length(x["out"]))

    spanned = F.transform("flat", lambda x, i: F.struct(start(i).alias("start"), F.length(x["out"]).cast("long").alias("length"), x["attached"].alias("attached"), x["number"].alias("number"), x["type"].alias("type"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))
    located = based.withColumn("spans", spanned)
    loss = F.when(F.col("role") == LEARNED_ROLE, F.transform(F.filter("spans", lambda x: ~x["attached"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>"))
    found = F.transform(F.filter("spans", lambda x: x["attached"]), lambda x: F.struct(x["number"].alias("number"), F.col("turn").alias("turn"), x["type"].alias("type"), x["ref"].alias("ref"), x["tokens"].alias("tokens"), x["start"].alias("start")))
    gathered = located.select("conv_id", F.struct("place", "piece", loss.alias("loss"), found.alias("found")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    attachments = F.flatten(F.transform("t", lambda x: x["found"]))
    return gathered.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), F.flatten(F.transform("t", lambda x: x["loss"])).alias("loss_spans"), attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted conversation: an array of ``role, text``, unescaped."""
    mark = r"(?s)^<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"
    written = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(F.slice(written, 1, F.size(written) - 1), lambda x: F.struct(unescape(F.regexp_extract(x, mark, 1)).alias("role"), unescape(F.regexp_extract(x, mark, 2)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped: an array in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
