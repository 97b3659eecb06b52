"""Chat formatting that is checked by a grammar round trip. DataFrame functions only.

Grammar of the output, a deterministic one::

    conversation = { turn }
    turn         = "[INST]" role "[/INST]" text "</s>"

Roles and texts hold none of the three control strings. A turn is first rendered as it is and parsed again; where the
parse fails or gives another role or text, the turn is rendered with its escapes and parsed once more. Escapes name the
characters that control strings begin with, so an escaped text cannot hold one, and the parser always takes escapes
back; a text that happens to look escaped is thereby found by the round trip as well. The turns' frames cannot overlap,
so the parse of a conversation is that of its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
#: What the escapes stand for; the backslash is escaped first and taken back last.
ESCAPES = (("\\", "\\b"), ("[", "\\s"), ("<", "\\l"))
ASSISTANT = "assistant"
#: Turns that are put together before the blocks of a conversation are.
BLOCK = 1024


def escape(text: Column) -> Column:
    for plain, name in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(name))
    return text


def unescape(text: Column) -> Column:
    for plain, name in reversed(ESCAPES):
        text = F.replace(text, F.lit(name), F.lit(plain))
    return text


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END))


def _holds(text: Column) -> Column:
    return F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)) | F.contains(text, F.lit(END))


def parse_turn(turn: Column) -> Column:
    """struct(role, text) of one rendered turn; null if it is not exactly one turn of the grammar."""
    inner = F.substr(turn, F.lit(len(OPEN) + 1), F.char_length(turn) - len(OPEN) - len(END))
    role = F.substring_index(inner, CLOSE, 1)
    text = F.substr(inner, F.char_length(role) + len(CLOSE) + 1)
    framed = F.startswith(turn, F.lit(OPEN)) & F.endswith(turn, F.lit(END)) & F.contains(inner, F.lit(CLOSE))
    return F.when(framed & ~_holds(role) & ~_holds(text), F.struct(unescape(role).alias("role"), unescape(text).alias("text")))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of struct(role, text)."""
    turns = F.split(formatted, "</s>", -1)
    return F.transform(F.slice(turns, F.lit(1), F.size(turns) - 1), lambda t: parse_turn(F.concat(t, F.lit(END))))


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn_no, role, text, rendered, escaped) for each row; nulls in role and text are empty."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn_no"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    same = lambda turn: F.coalesce((turn["role"] == F.col("role")) & (turn["text"] == F.col("text")), F.lit(False))
    first = rows.withColumn("plain", render(F.col("role"), F.col("text"))).withColumn("escaped", ~same(parse_turn(F.col("plain"))))
    second = first.withColumn("rendered", F.when(F.col("escaped"), render(escape(F.col("role")), escape(F.col("text")))).otherwise(F.col("plain")))
    proven = F.when(~F.col("escaped") | same(parse_turn(F.col("rendered"))), F.col("rendered")).otherwise(F.raise_error(F.lit("a turn does not survive the round trip")))
    return second.select("conv", "turn_no", "role", "text", proven.alias("rendered"), "escaped")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id``: ``formatted``, ``n_turns``, ``loss_spans`` (start, end in code points, end exclusive, of each assistant text), ``n_escaped``.

    Turns are in order of ``turn`` (nulls first), equal ones by role and text; repeated rows are repeated turns. Null
    roles and texts are empty. Rows without ``conv_id`` are one conversation without id. An empty table gives no rows.
    The turns are rendered and checked row by row; a block of turn numbers is put together before its conversation is.
    """
    turns = formatted_turns(conversations)
    body = F.char_length("rendered") - len(END) - F.char_length(F.when(F.col("escaped"), escape(F.col("text"))).otherwise(F.col("text")))
    row = F.struct("turn_no", "role", "text", "rendered", F.when(F.col("role") == ASSISTANT, body).alias("body"), "escaped")
    blocks = turns.groupBy("conv", F.floor(F.col("turn_no") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    # lengths run on over the turns of a block: struct(at, spans)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state, r):
        span = F.struct((state["at"] + r["body"]).alias("start"), (state["at"] + F.char_length(r["rendered"]) - len(END)).alias("end"))
        return F.struct((state["at"] + F.char_length(r["rendered"])).alias("at"), F.when(r["body"].isNotNull(), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    blocks = blocks.select(
        "conv", "block", F.array_join(F.transform("rows", lambda r: r["rendered"]), "").alias("piece"), F.aggregate("rows", start, step)["spans"].alias("spans"), F.size("rows").alias("n"), F.size(F.filter("rows", lambda r: r["escaped"])).alias("n_escaped")
    )
    whole = blocks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "piece", "spans"))).alias("pieces"), F.sum("n").alias("n_turns"), F.sum("n_escaped").alias("n_escaped"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("spans"))

    def shift(state, p):
        moved = F.transform(p["spans"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), (s["end"] + state["at"]).alias("end")))
        return F.struct((state["at"] + F.char_length(p["piece"])).alias("at"), F.concat(state["spans"], F.array(moved)).alias("spans"))

    return whole.select(
        F.col("conv").alias("conv_id"), F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "n_turns", F.flatten(F.aggregate("pieces", first, shift)["spans"]).alias("loss_spans"), "n_escaped"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """From ``format_chats``: ``turns`` parsed from the output, ``loss_text`` under the loss mask, unescaped.

    Texts under the mask are joined in order with nothing between; each is cut out of the output by its span.
    """
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked.alias("loss_text"))
