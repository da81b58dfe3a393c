"""Chat formatting with typed content parts, a loss mask and an exact way back.

A visitor has one method for each kind of part and gives a column: the piece that stands in the text, and for
attachments the reference and the number of tokens to which the placeholder expands. Control characters of the
template are written as two-character codes inside texts and roles, so the template's own strings can occur nowhere
else and the way back needs no guess. All of it is column expressions.

Turns are formatted in segments of consecutive turn numbers, so a conversation of any length is spread over tasks and
no text outgrows memory. Only a digest of a whole conversation must read it in order: it is streamed, segment by
segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters of the template and their codes; the backslash, which begins every code, is the last to be decoded.
CODES = {"\\": "\\b", "<": "\\l", "#": "\\h", ":": "\\c"}
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
#: Turn numbers in a segment.
SEGMENT = 64


def escaped(text: Column) -> Column:
    """A text without any character of the template."""
    for char, code in CODES.items():
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for char, code in reversed(CODES.items()):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


@dataclass(frozen=True)
class PartVisitor:
    """What each kind of part becomes. Sizes are per token: image patches, audio seconds, document pages.

    A part is struct(kind, text, ref, width, height, seconds, pages). Missing sizes count as 0.
    """

    patch: int = 14
    tokens_per_second: int = 25
    tokens_per_page: int = 512

    def text(self, part: Column) -> Column:
        return self._piece(escaped(F.coalesce(part["text"], F.lit(""))))

    def image(self, part: Column) -> Column:
        side = lambda c: F.ceil(F.coalesce(part[c], F.lit(0)) / self.patch)
        return self._attached(part, "image", side("width") * side("height"))

    def audio(self, part: Column) -> Column:
        return self._attached(part, "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.tokens_per_second))

    def document(self, part: Column) -> Column:
        return self._attached(part, "document", F.coalesce(part["pages"], F.lit(0)) * self.tokens_per_page)

    def other(self, part: Column) -> Column:
        """A null part is nothing; an unknown kind keeps its place and reference and expands to no token."""
        return F.when(part.isNull(), self._piece(F.lit(""))).otherwise(self._attached(part, "other", F.lit(0)))

    def visit(self, part: Column) -> Column:
        """struct(piece, kind, ref, tokens); kind is null for texts."""
        out = F.when(part["kind"] == "text", self.text(part))
        for kind in ("image", "audio", "document"):
            out = out.when(part["kind"] == kind, getattr(self, kind)(part))
        return out.otherwise(self.other(part))

    @staticmethod
    def _piece(piece: Column, kind: Column | None = None, ref: Column | None = None, tokens: Column | None = None) -> Column:
        null = F.lit(None)
        return F.struct(piece.alias("piece"), (null if kind is None else kind).cast("string").alias("kind"), (null if ref is None else ref).cast("string").alias("ref"), (F.lit(0) if tokens is None else tokens).cast("long").alias("tokens"))

    def _attached(self, part: Column, kind: str, tokens: Column) -> Column:
        return self._piece(F.lit(f"<{kind}>"), F.lit(kind), part["ref"], tokens)


def text_part(text: Column) -> Column:
    """An array with one part, a text."""
    null = F.lit(None)
    fields = {"kind": F.lit("text"), "text": text, "ref": null.cast("string"), "width": null.cast("long"), "height": null.cast("long"), "seconds": null.cast("double"), "pages": null.cast("long")}
    return F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))


def format_conversations(messages: DataFrame, visitor: PartVisitor = PartVisitor(), learn: str = "assistant", segment: int = SEGMENT) -> DataFrame:  # noqa: B008
    """(conv_id, segment, n_turns, formatted, loss, attachments) of ``messages`` (conv_id, turn, role, text or parts).

    formatted is the text of the turns in order of turn, role and content as written; a conversation is its segments in order.
    loss is an array of struct(start, length), in code points of formatted: the content of each turn of role ``learn``
    and nothing of the template. attachments has struct(turn, part, kind, ref, start, tokens) for each placeholder
    in order. Turns come by number, null turns first, in a segment of their own. Null texts, roles and part arrays are
    empty; a null conv_id is one conversation. Repeated rows are turns of their own. Whole texts are kept, however long. Other columns
    are left out, so none can clash. An empty table gives no rows.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(messages.schema["parts"].dataType)) if "parts" in messages.columns else text_part(F.col("text"))
    pieces = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.transform(parts, visitor.visit).alias("pieces"))
    turns = (
        pieces.select("conv_id", "turn", "role", F.array_join(F.col("pieces.piece"), "").alias("content"), "pieces")
        .withColumn("head", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(AFTER_ROLE)))
        .select("conv_id", F.floor(F.col("turn") / segment).alias("segment"), F.struct("turn", "role", "content", "head", F.length("head").alias("n_head"), F.length("content").alias("n_content"), "pieces").alias("t"))
    )
    grouped = turns.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # where each turn begins: a running sum along the array
    step = lambda acc, t: F.struct((acc["at"] + t["n_head"] + t["n_content"] + len(CLOSE)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    placed = grouped.withColumn("starts", F.aggregate("turns", zero, step, lambda acc: acc["starts"]))

    def attached(t: Column, start: Column) -> Column:
        """The placeholders of one turn and where they begin."""
        before = lambda k: F.aggregate(F.slice(t["pieces"], 1, k), F.lit(0), lambda n, p: n + F.length(p["piece"]))
        each = F.transform(t["pieces"], lambda p, k: F.struct(t["turn"].alias("turn"), k.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), (start + t["n_head"] + before(k)).alias("start"), p["tokens"].alias("tokens")))
        return F.filter(each, lambda a: a["kind"].isNotNull())

    spans = F.zip_with("turns", "starts", lambda t, s: F.struct((t["role"] == learn).alias("learn"), (s + t["n_head"]).alias("start"), t["n_content"].alias("length")))
    return placed.select(
        "conv_id",
        "segment",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss"),
        F.flatten(F.zip_with("turns", "starts", attached)).alias("attachments"),
    )


def turns_of(formatted: Column) -> Column:
    """Back from a formatted text: an array of struct(role, text). Placeholders stand in the text as they are."""
    turns = F.filter(F.split(formatted, CLOSE), lambda t: t != "")
    role = lambda t: F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), AFTER_ROLE, 1)
    text = lambda t: F.substr(t, F.lit(len(OPEN) + len(AFTER_ROLE) + 1) + F.length(role(t)))
    return F.transform(turns, lambda t: F.struct(unescaped(role(t)).alias("role"), unescaped(text(t)).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, spans one after another."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def digests(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted segments.

    turns_sha256 is of role, line feed, text, line feed for each turn. Segments meet by conversation and are hashed in
    order as they stream by, one batch in memory.
    """
    lines = F.array_join(F.transform(turns_of(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = segments.select("conv_id", "segment", F.size(turns_of(F.col("formatted"))).cast("long").alias("n_turns"), lines.alias("lines"), loss_text(F.col("formatted"), F.col("loss")).alias("learnt"), F.length("formatted").cast("long").alias("chars"))
    kind = segments.schema["conv_id"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, conv, id_type = None, None, None

        def closed(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c) for c in columns[1:]]], names)

        for batch in batches:
            done, id_type = [], batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != conv:
                    if now is not None:
                        done.append((conv, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4]))
                    conv, now = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[0] += r["n_turns"]
                now[1].update(r["lines"].encode())
                now[2] += len(r["learnt"])
                now[3].update(r["learnt"].encode())
                now[4] += r["chars"]
            if done:
                yield closed(done)
        if now is not None:
            yield closed([(conv, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4])])

    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(stream, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the query adds: both of its turns say this.
HARD = "\\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit(HARD).alias("text"))
    return digests(format_conversations(messages.unionByName(hard)))


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), coded AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c') AS code FROM said
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, code)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, code) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + length(code) + 14)::BIGINT AS formatted_chars
FROM coded GROUP BY conv_id
"""
