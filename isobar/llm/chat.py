"""Chat formatting by event sourcing: fold a log of message events, then render it.

A log row is an event of one message: ``message`` (its first text), ``delta`` (text to
append), ``edit`` and ``regenerate`` (the text starts anew). Events are put in order by
sequence number and folded per message, so that one long conversation is spread over
tasks. Rendering runs on ranges of (conversation, message); each range yields bounded
chunks of text with the loss mask of the assistant's words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from isobar.llm.common import arrow_schema

#: The template: ``<turn ROLE>\n TEXT \n</turn>\n``; "<" and "\" inside a text get a "\".
OPEN, HEAD_END, CLOSE = "<turn ", ">\n", "\n</turn>\n"
TURN = re.compile(r"<turn ((?:[^<>\\\n]+|\\.)*)>\n((?:[^<\\]+|\\.)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
CHUNK_CHARS = 1 << 20

CHUNKS = "conv_id {kind}, msg bigint, part bigint, chunk string, loss array<struct<start:int,end:int>>"


def escape(col: Column, more: str = "") -> Column:
    return F.regexp_replace(col, rf"([\\<{more}])", r"\\$1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def fold(events: DataFrame) -> DataFrame:
    """Final messages of a log: (conv_id, msg, part, role, text).

    ``events`` has conv_id, msg, part, seq, op, role, text. A message's text starts at its
    last event that is not a delta and goes on with the deltas after it; with none, all
    deltas count. The role is that of the first event that names one. Null texts and
    roles are empty, a null op is a message. Events with equal numbers are taken by op,
    ``message`` before the rest, then by text. A null conv_id is a conversation of its
    own. Later messages stay when an earlier one is regenerated.
    """
    op = F.coalesce(F.col("op"), F.lit("message"))
    rank = F.when(op == "message", 0).when(op == "delta", 2).otherwise(1)
    text = F.coalesce("text", F.lit(""))
    event = F.struct(F.col("seq"), rank.alias("rank"), text.alias("text"))
    grouped = events.groupBy("conv_id", "msg", "part").agg(
        F.array_sort(F.collect_list(event)).alias("log"),
        F.max(F.when(op != "delta", event)).alias("base"),
        F.min_by(F.when(F.col("role").isNotNull(), F.col("role")), F.when(F.col("role").isNotNull(), F.struct("seq", rank, "role"))).alias("role"),
    )
    kept = F.filter("log", lambda e: F.col("base").isNull() | (e > F.col("base")))
    tail = F.array_join(F.transform(kept, lambda e: e["text"]), "")
    return grouped.select(
        "conv_id", "msg", "part",
        F.coalesce("role", F.lit("")).alias("role"),
        F.concat(F.coalesce(F.col("base")["text"], F.lit("")), tail).alias("text"),
    )


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """Chunks of rendered turns with their loss mask, in order of (msg, part).

    Ranges of (conv_id, msg, part) are rendered apart, so no conversation is held whole. A
    chunk ends after ``CHUNK_CHARS`` or at the end of its range; it is named after its
    first message. ``loss`` holds code-point spans of the escaped texts of ``learn``.
    """
    kind = messages.schema["conv_id"].dataType.simpleString()
    schema = CHUNKS.format(kind=kind)
    keys = ["conv_id", "msg", "part"]
    head = F.concat(F.lit(OPEN), escape(F.col("role"), ">\n"), F.lit(HEAD_END))
    body = escape(F.col("text"))
    turns = messages.select(*keys, head.alias("head"), body.alias("body"), (F.col("role") == learn).alias("learn"))
    ranged = turns.repartitionByRange(*keys).sortWithinPartitions(*keys)

    want = arrow_schema(schema)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, parts, size, spans, out = None, [], 0, [], []

        def done():
            out.append({"conv_id": row[0], "msg": row[1], "part": row[2], "chunk": "".join(parts), "loss": spans})

        for batch in batches:
            for conv, msg, part, head, body, is_learn in zip(*(c.to_pylist() for c in batch.columns)):
                if row is None or row[0] != conv or size >= CHUNK_CHARS:
                    if row is not None:
                        done()
                    row, parts, size, spans = (conv, msg, part), [], 0, []
                if is_learn:
                    spans.append({"start": size + len(head), "end": size + len(head) + len(body)})
                parts += (head, body, CLOSE)
                size += len(head) + len(body) + len(CLOSE)
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=want)
                out = []
        if row is not None:
            done()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=want)

    return ranged.mapInArrow(chunks, schema)


def read_back(chunks: DataFrame) -> DataFrame:
    """Per conversation, what the rendered chunks say, parsed from the text alone.

    The digests chain over a whole conversation, so its chunks stream through one task in
    order; only one chunk is held at a time. Sizes of conversations bound that stream's
    time, never its memory.
    """
    kind = chunks.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    ordered = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "msg", "part")

    want = arrow_schema(schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def done():
            n, turns, loss, loss_sha, chars = state
            out.append(dict(zip(want.names, (now[0], n, turns.hexdigest(), loss, loss_sha.hexdigest(), chars))))

        for batch in batches:
            convs, _, _, texts, masks = (c.to_pylist() for c in batch.columns)
            for conv, text, spans in zip(convs, texts, masks):
                if now is None or now[0] != conv:
                    if now is not None:
                        done()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for turn in TURN.finditer(text):
                    state[0] += 1
                    state[1].update(f"{unescape(turn[1])}\n{unescape(turn[2][:-1])}\n".encode())
                for span in spans:
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema=want)
                out = []
        if now is not None:
            done()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=want)

    return ordered.mapInArrow(digests, schema)


def as_events(conversations: DataFrame) -> DataFrame:
    """Finished turns as a log of ``message`` events; repeated turns stay apart."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("msg"),
        F.row_number().over(same).cast("bigint").alias("part"),
        F.col("turn").cast("bigint").alias("seq"), F.lit("message").alias("op"), "role", "text",
    )
