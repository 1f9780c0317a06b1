"""Chat formatting with typed content parts.

A message holds ordered parts ``(kind, text, ref, tokens)``. A visitor turns each part into text of the template: a text part becomes its
escaped text; an image, audio or document part becomes a numbered placeholder, and its reference, its place and the tokens it expands to
are recorded as an attachment. Turns are joined in the order of ``turn``; assistant texts get a loss span.

Template: ``<|im_start|>role<|im_sep|>content<|im_end|>``. Inside roles and texts a backslash is doubled and every control string is
broken by a backslash after its first character, so no control string of the output comes from a text, and dropping one backslash of
each pair gives the text back.

Main path: DataFrame functions only. One conversation is one output row and so meets in one task, like the row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunked, let, only, running, table, text_of

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Tokens one attachment expands to when the part does not say so.
TOKENS = {"image": 576, "audio": 750, "document": 1024}

PART = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("tokens", T.LongType()),
    ]
)


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"<(?=\||/?s>|</?SYS>)|\[(?=/?INST\])", "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def text_part(text: Column) -> Column:
    """One text as the parts of a message."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            text.alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("long").alias("tokens"),
        )
    )


def _visit(part: Column) -> Column:
    """The template's text of one part; the number of a placeholder is filled in later."""
    kind = F.lower(F.coalesce(part["kind"], F.lit("text")))
    placeholder = F.concat(F.lit("<|"), kind, F.lit("|>"))
    return F.when(kind.isin(*TOKENS), placeholder).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _expanded(part: Column) -> Column:
    default = F.create_map(*[F.lit(x) for pair in TOKENS.items() for x in pair])
    return F.coalesce(part["tokens"], default[F.lower(part["kind"])].cast("long"))


def format_chat(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, role, parts)`` to one row per conversation.

    Columns: ``conv_id``, ``formatted``, ``loss_spans`` (start and end in code points of the assistants' contents), ``attachments``
    (number, kind, ref, turn index, tokens) and ``expanded_tokens`` (sum over the attachments).

    Null roles and texts are empty; an unknown part kind counts as text; null ``parts`` give an empty content. Turns with equal numbers
    are ordered by role and content; a null turn comes first; rows without ``conv_id`` form one conversation of their own. Repeated rows
    are repeated turns.
    """
    rows = only(messages, conv_id="conv_id", turn="turn", role=F.coalesce(F.col("role"), F.lit("")), parts="parts")
    parts = F.coalesce(F.col("parts"), F.array().cast(T.ArrayType(PART)))
    attached = F.filter(parts, lambda p: F.lower(F.coalesce(p["kind"], F.lit(""))).isin(*TOKENS))
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        F.concat_ws("", F.transform(parts, _visit)).alias("content"),
        F.transform(
            attached,
            lambda p: F.struct(F.lower(p["kind"]).alias("kind"), p["ref"].alias("ref"), _expanded(p).alias("tokens")),
        ).alias("files"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content", "files"))).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))
    blocks = F.transform(
        F.col("turns"),
        lambda t: F.struct(
            F.concat(head(t), t["content"], F.lit(END)).alias("block"),
            F.length(head(t)).alias("at"),
            F.length(t["content"]).alias("n"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )

    def place(acc, b):
        start = acc["pos"] + b["at"]
        span = F.array(F.struct(start.alias("start"), (start + b["n"]).alias("end")))
        return F.struct(
            (acc["pos"] + F.length(b["block"])).cast("int").alias("pos"),
            F.when(b["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    def placed(pieces):
        """Positions are summed piece by piece, so that a long conversation takes time in proportion to it."""
        totals = F.transform(pieces, lambda piece: F.aggregate(piece, F.lit(0), lambda a, b: (a + F.length(b["block"])).cast("int")))
        zero = lambda at: F.struct(at.alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
        return let(running(totals, F.lit(0)), lambda before: F.flatten(F.zip_with(pieces, before, lambda piece, at: F.aggregate(piece, zero(at), place)["spans"])))

    files = F.flatten(
        F.transform(
            F.col("turns"),
            lambda t, i: F.transform(
                t["files"],
                lambda f: F.struct(f["kind"].alias("kind"), f["ref"].alias("ref"), i.alias("turn_index"), f["tokens"].alias("tokens")),
            ),
        )
    )
    return (
        turns.withColumn("blocks", blocks)
        .withColumn("files", files)
        .select(
            "conv_id",
            F.concat_ws("", F.transform("blocks", lambda b: b["block"])).alias("formatted"),
            let(F.col("blocks"), lambda b: let(chunked(b), placed)).alias("loss_spans"),
            F.transform(
                "files",
                lambda f, i: F.struct(
                    (i + 1).alias("number"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["turn_index"], f["tokens"].alias("tokens")
                ),
            ).alias("attachments"),
            F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["tokens"]).alias("expanded_tokens"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns ``(role, text)`` read back from a formatted conversation."""
    blocks = F.split(formatted, r"<\|im_end\|>")
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    inner = F.transform(blocks, lambda b: F.split(F.substr(b, F.lit(len(START) + 1)), r"<\|im_sep\|>"))
    return F.transform(inner, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss spans, unescaped, nothing between; each piece of spans looks only at its own stretch of the text."""

    def under(piece):
        low = F.get(piece, F.lit(0))["start"]
        stretch = F.substr(formatted, low + 1, F.element_at(piece, -1)["end"] - low)
        return let(stretch, lambda c: F.array_join(F.transform(piece, lambda s: unescape(F.substr(c, s["start"] - low + 1, s["end"] - s["start"]))), ""))

    return let(spans, lambda all_spans: F.array_join(F.transform(chunked(all_spans), under), ""))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", text_of().alias("text")
    )
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    messages = rows.unionByName(probe).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    out = format_chat(messages).withColumn("turns", read_turns(F.col("formatted")))
    lost = loss_text(F.col("formatted"), F.col("loss_spans"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", line)), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
e AS (
  SELECT *, length(replace(text, chr(92), chr(92) || chr(92)))
    + len(regexp_extract_all(text, '<\||</?s>|<</?SYS>|\[/?INST\]')) AS body,
    length(replace(role, chr(92), chr(92) || chr(92)))
    + len(regexp_extract_all(role, '<\||</?s>|<</?SYS>|\[/?INST\]')) AS head
  FROM m
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(head + body + 12 + 10 + 10)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
