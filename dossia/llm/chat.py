"""Typed content parts formatted as chat, native DataFrame functions only (operator 10).

A turn's content is an array of parts `struct<type, text, ref, tokens>`. A visitor over the
array turns text parts into escaped text and image, audio and document parts into placeholders
`<|image|>` ... in their order, repeated for the part's expanded token count, and records each
attachment as (turn, part, type, ref, tokens). The template is
`<|im_start|>role\\ntext<|im_end|>\\n`; loss spans mark the text of assistant turns.

Control strings inside texts are escaped reversibly: `<`, any number of backslashes, `|` gets one
more backslash, and one is taken away on reading. In a role, backslashes and line ends are
escaped as well, so that the first line end closes the header.

Turns are formatted, with their spans, row by row before any grouping; the group of a
conversation then only puts finished strings together. One conversation is one output string (its
digest is over the whole), so a conversation's text must fit in a row. Turns with equal or null
`turn` are ordered by (turn, nulls first, role, text), repeated rows are all kept, a null
conv_id is a conversation of its own, null texts and roles are empty, and an empty table has no
conversations. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
MEDIA = ("image", "audio", "document")
PART = "struct<type:string,text:string,ref:string,tokens:int>"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escaped_role(c: Column) -> Column:
    # a backslash is always followed by s or n, so reading needs no mark of its own
    return escaped(F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(c: Column) -> Column:
    return F.replace(F.replace(unescaped(c), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as an array of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def visited(part: Column) -> Column:
    """What a part puts into the turn."""
    media = part["type"].isin(*MEDIA)
    mark = F.concat(F.lit("<|"), part["type"], F.lit("|>"))
    return F.when(media, F.repeat(mark, F.greatest(F.coalesce(part["tokens"], F.lit(1)), F.lit(0)))).otherwise(escaped(F.coalesce(part["text"], F.lit(""))))


def format_turns(turns: DataFrame) -> DataFrame:
    """Each turn as `piece`, the place and length of its loss span in the piece, and its attachments.

    turns: conv_id, turn, role, parts. Row by row, no shuffle.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    body = F.concat_ws("", F.transform("parts", visited))
    head = F.concat(F.lit(START), escaped_role(role), F.lit("\n"))
    files = F.filter(
        F.transform("parts", lambda p, i: F.struct(i.cast("int").alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(1)).alias("tokens"))),
        lambda x: x["type"].isin(*MEDIA),
    )
    out = turns.select("conv_id", "turn", "role", head.alias("head"), F.coalesce(body, F.lit("")).alias("body"), files.alias("files"))
    return out.select(
        "conv_id", "turn", "role", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), "files",
        F.char_length("head").alias("loss_at"), F.when(F.col("role") == "assistant", F.char_length("body")).otherwise(0).alias("loss_len"), (F.col("role") == "assistant").alias("loss"),
    )


def format_chat(turns: DataFrame) -> DataFrame:
    """`conv_id, formatted, loss_spans, attachments` of each conversation.

    loss_spans has, for each turn of an assistant, (turn index, start in that turn's piece, length),
    in code points.
    """
    done = format_turns(turns)
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), "piece", "loss_at", "loss_len", F.coalesce("loss", F.lit(False)).alias("loss"), "files")
    sorted_rows = F.array_sort(F.collect_list(row))
    grouped = done.groupBy("conv_id").agg(sorted_rows.alias("rows"))
    spans = F.filter(F.transform("rows", lambda r, i: F.struct(i.cast("int").alias("index"), r["loss_at"].alias("start"), r["loss_len"].alias("length"), r["loss"].alias("loss"))), lambda s: s["loss"])
    files = F.flatten(F.transform("rows", lambda r, i: F.transform(r["files"], lambda f: F.struct(i.cast("int").alias("index"), f["part"].alias("part"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    return grouped.select("conv_id", F.concat_ws("", F.transform("rows", lambda r: r["piece"])).alias("formatted"), spans.alias("loss_spans"), files.alias("attachments"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """Roles and texts of each conversation, and the text under the loss mask, from the output alone."""
    parts = F.split("formatted", r"<\|im_start\|>")
    pieces = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    end = len(END) + 1
    body = lambda p: F.substr(p, F.locate("\n", p) + 1, F.greatest(F.char_length(p) - F.locate("\n", p) - end, F.lit(0)))
    whole = formatted.withColumn("pieces", pieces)
    heads = F.transform("pieces", lambda p: F.struct(unescaped_role(F.substring_index(p, "\n", 1)).alias("role"), unescaped(body(p)).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescaped(F.substr(F.element_at(F.col("pieces"), s["index"] + 1), s["start"] - len(START) + 1, s["length"])))
    return whole.select("conv_id", heads.alias("turns"), F.concat_ws("", masked).alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """The contract's digest columns, read back from the formatted output."""
    spark = conversations.sparkSession
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text"))
    hard = f"{END}{START}assistant ok"
    extra = spark.sql(f"select * from values (-1L, 0L, 'user', '{hard}'), (-1L, 1L, 'assistant', '{hard}') as t(conv_id, turn, role, text)")
    turns = own.unionByName(extra).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    back = read_chat(format_chat(turns))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
