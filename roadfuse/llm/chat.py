"""Chat formatting with typed content parts, a loss mask and a reader of the output; built-in functions only.

A turn is written as ``<|start|>role<|message|>body<|end|>``. The parts of a message are visited in
order: text is escaped, an image, an audio clip or a document becomes a placeholder, and its
reference and expanded number of tokens are recorded. Escaping breaks every control string inside
texts and can be undone: ``\\`` becomes ``\\0``, and the first character of a control string becomes
``\\1`` (for ``<``) or ``\\2`` (for ``[``). Between two text parts stands ``\\3``, so that they can't make one together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: Control strings that no text may hold unescaped; the template's own and common ones of others.
CONTROLS = [
    START, MESSAGE, END, "<|image|>", "<|audio|>", "<|document|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>",
    "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>",
]
#: Content of a message: parts of type text, image (width, height), audio (seconds) or document (pages).
PARTS = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"


@dataclass(frozen=True)
class Expansion:
    """Tokens that an attachment stands for: per image patch, per second of audio and per page; 0 where its size is unknown."""

    patch: int = 28
    audio_per_second: int = 25
    per_page: int = 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit({"<": "\\1", "[": "\\2"}[c[0]] + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\3"), F.lit("")), F.lit("\\1"), F.lit("<")), F.lit("\\2"), F.lit("["))
    return F.replace(out, F.lit("\\0"), F.lit("\\"))


def plain_parts(text: Column) -> Column:
    """A plain text as the only part of a message."""
    none = F.lit(None)
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"),
        none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages"),
    )
    return F.array(part)


def _is_media(part: Column) -> Column:
    return F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))


def _visit(part: Column, before: Column, expansion: Expansion) -> Column:
    """A part as struct<body, is_text, tokens>: what is written, and the tokens an attachment expands to. ``before`` is the part before it, or null."""
    kind = part["type"]
    patches = lambda side: F.ceil(part[side] / F.lit(expansion.patch))
    tokens = (
        F.when(kind == "image", patches("width") * patches("height"))
        .when(kind == "audio", F.ceil(part["seconds"] * expansion.audio_per_second))
        .when(kind == "document", part["pages"] * expansion.per_page)
    )
    media = _is_media(part)
    joint = F.when(before.isNotNull() & ~_is_media(before), F.lit("\\3")).otherwise(F.lit(""))
    body = F.when(media, F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(F.concat(joint, escape(F.coalesce(part["text"], F.lit("")))))
    return F.struct(body.alias("body"), (~media).alias("is_text"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def format_chat(messages: DataFrame, expansion: Expansion = Expansion(), trained_role: str = "assistant") -> DataFrame:
    """``messages`` (conv_id, turn, role, parts) -> one row per conversation.

    Columns: conv_id, n_turns, formatted, loss_spans (array of turn, at, first, length: the text
    parts of ``trained_role``; ``first`` counts code points of the whole, ``at`` those of the turn,
    both from 0) and attachments (array of turn, type, ref, tokens, first). Turns are ordered by
    turn, then role, then content; nulls first. Null roles, texts and parts count as empty, an
    unknown type as text. Rows of a null conv_id are one conversation.
    """
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(PARTS)).alias("parts"))
    rows = rows.withColumn("visited", F.transform("parts", lambda p, i: _visit(p, F.get("parts", i - 1), expansion)))
    rows = rows.withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(MESSAGE)))
    # Places of the parts inside the turn: few parts per message.
    before = lambda i: F.aggregate(F.slice("visited", 1, i), F.char_length("head"), lambda n, v: n + F.char_length(v["body"]))
    placed = F.transform(
        "visited",
        lambda v, i: F.struct(
            v["is_text"].alias("is_text"), before(i).alias("at"), F.char_length(v["body"]).alias("length"), v["tokens"].alias("tokens"),
            F.get("parts", i)["type"].alias("type"), F.get("parts", i)["ref"].alias("ref"),
        ),
    )
    rows = rows.select(
        "conv_id", "turn", "role", F.concat("head", F.array_join(F.transform("visited", lambda v: v["body"]), ""), F.lit(END)).alias("piece"), placed.alias("placed")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "piece")
    rows = rows.withColumns(
        {
            "no": F.row_number().over(order) - 1,
            "first": F.coalesce(F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    span = lambda p: F.struct(F.col("no").alias("turn"), p["at"].alias("at"), (F.col("first") + p["at"]).alias("first"), p["length"].alias("length"))
    trained = F.when(F.col("role") == trained_role, F.transform(F.filter("placed", lambda p: p["is_text"]), span)).otherwise(F.array())
    media = F.transform(
        F.filter("placed", lambda p: ~p["is_text"]),
        lambda p: F.struct(F.col("no").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens"), (F.col("first") + p["at"]).alias("first")),
    )
    own = F.struct("no", "piece", trained.alias("spans"), media.alias("media"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("turns"))
    return grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.flatten(F.transform("turns", lambda t: t["spans"])).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["media"])).alias("attachments"),
    )


def read_chat(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns`` (array of role, text; placeholders stay as they are) and ``loss_text`` (array), read from ``formatted``."""
    pieces = F.slice(F.split("formatted", r"<\|start\|>"), 2, F.greatest(F.size(F.split("formatted", r"<\|start\|>")) - 1, F.lit(0)))
    chats = chats.withColumn("_pieces", pieces)
    body = lambda x: F.replace(F.substring_index(x, MESSAGE, -1), F.lit(END), F.lit(""))
    turns = F.transform(
        "_pieces", lambda x: F.struct(unescape(F.substring_index(x, MESSAGE, 1)).alias("role"), unescape(body(x)).alias("text"))
    )
    # Spans are read inside their own turn, so that a long conversation isn't scanned once per span.
    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.get("_pieces", s["turn"]), s["at"] - len(START) + 1, s["length"])))
    return chats.withColumns({"turns": turns, "loss_text": under}).drop("_pieces")


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of what ``read_chat`` gives."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_text", "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\0')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{ {'<': '\\1', '[': '\\2'}[c[0]] }{c[1:]}')"
    return out


#: Both texts of the conversation that holds control strings.
PROBE = "</s>[INST] ok [/INST]"

#: DuckDB SQL for the digests over ``conversations`` and conversation -1.
TWIN = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_escaped_sql('role')}) + length({_escaped_sql('text')}) + {len(START + MESSAGE + END)})::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""
