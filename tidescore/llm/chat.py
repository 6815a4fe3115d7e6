r"""Chat formatting with typed content parts.

A visitor flattens each message's parts (text, image, audio, document) in order. A text part becomes escaped text; any
other part becomes a placeholder `<image:0>` that numbers the conversation's attachments, and is recorded with its
reference and the tokens it expands to. Template of a turn:

    <turn role>\n text </turn>\n            (no blanks inside; role and text escaped)

In texts and roles a backslash is put before every backslash and `<`, so that no text can hold a control string; in roles
also before `>`. Reading back removes one backslash before any character, so every text returns as it was. The loss mask
is a list of [start, end) spans of code points in the formatted string, one for each text part of an assistant turn.

Defined cases: null text is empty; a null role is the empty role; turns sort by turn (null first), role, text; rows that
repeat a turn are each kept; a conversation with a null id is one conversation; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescore.llm import common

LOSS_ROLE = "assistant"
#: Side of an image patch in pixels, patches merged into a token, audio tokens a second, tokens of a document page.
IMAGE_PATCH, PATCHES_PER_TOKEN, AUDIO_TOKENS_PER_S, DOCUMENT_TOKENS_PER_PAGE = 14, 4, 25, 256

_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\>]++|\\.)*+)>\n((?:[^\\<]++|\\.|<(?:image|audio|document):\d+>)*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Formatter:
    """The visitor: visit_<type> for each type of part; turns are added in order."""

    pieces: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0
    turns: int = 0

    def put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit_text(self, part: dict, loss: bool) -> None:
        text = part.get("text") or ""
        start = self.length
        self.put(escape(text))
        self.tokens += len(text.encode().split())
        if loss:
            self.spans.append((start, self.length))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"n": len(self.attachments), "type": kind, "ref": part.get("ref"), "turn": self.turns, "tokens": tokens})
        self.put(f"<{kind}:{len(self.attachments) - 1}>")
        self.tokens += tokens

    def visit_image(self, part: dict, loss: bool) -> None:
        patches = math.ceil((part.get("width") or 0) / IMAGE_PATCH) * math.ceil((part.get("height") or 0) / IMAGE_PATCH)
        self.attach("image", part, math.ceil(patches / PATCHES_PER_TOKEN))

    def visit_audio(self, part: dict, loss: bool) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * AUDIO_TOKENS_PER_S))

    def visit_document(self, part: dict, loss: bool) -> None:
        self.attach("document", part, (part.get("pages") or 0) * DOCUMENT_TOKENS_PER_PAGE)

    def add(self, role: str, parts: list[dict]) -> None:
        self.put(f"<turn {escape(role).replace('>', chr(92) + '>')}>\n")
        for part in parts:
            visit = getattr(self, f"visit_{part.get('type') or 'text'}", None)
            if visit is None:
                raise ValueError(f"unknown type of part: {part.get('type')!r}")
            visit(part, role == LOSS_ROLE)
        self.put("</turn>\n")
        self.turns += 1

    def result(self) -> dict:
        return {"formatted": "".join(self.pieces), "spans": [list(x) for x in self.spans], "attachments": self.attachments, "n_tokens": self.tokens}


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, body) of each turn of a formatted string; placeholders stay as they are."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


FORMATTED = "formatted string, spans array<array<int>>, attachments array<struct<n:int,type:string,ref:string,turn:int,tokens:bigint>>, n_tokens bigint"


def format_conversations(turns: DataFrame, parts_col: str | None = None) -> DataFrame:
    """conv_id and FORMATTED, one row per conversation of (conv_id, turn, role, text).

    parts_col: a column with a message's parts as a JSON list, used instead of text where it isn't null. One shuffle by
    conversation; a task holds the conversation that it builds, and no other.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    parts = F.col(parts_col).cast("string") if parts_col else F.lit(None).cast("string")
    columns = [F.col("conv_id").alias("id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), parts.alias("parts")]
    ordered = turns.select(*columns).repartition("id").sortWithinPartitions("id", "turn", "role", "text", "parts")
    nested = pa.schema([("spans", pa.list_(pa.list_(pa.int32()))), ("attachments", pa.list_(pa.struct([("n", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("turn", pa.int32()), ("tokens", pa.int64())])))])

    def pack(ids: list, done: list[dict], id_type) -> pa.RecordBatch:
        arrays = [
            pa.array(ids, id_type), pa.array([d["formatted"] for d in done], pa.string()), pa.array([d["spans"] for d in done], nested.field(0).type),
            pa.array([d["attachments"] for d in done], nested.field(1).type), pa.array([d["n_tokens"] for d in done], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", "formatted", "spans", "attachments", "n_tokens"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        building, current, ids, done, size, id_type = None, None, [], [], 0, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, _, role, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if building is None or key != current:
                    if building is not None:
                        ids.append(current)
                        done.append(building.result())
                        size += building.length
                    if len(ids) >= 256 or size > 8_000_000:
                        yield pack(ids, done, id_type)
                        ids, done, size = [], [], 0
                    building, current = Formatter(), key
                building.add(role or "", [{"type": "text", "text": text}] if parts is None else json.loads(parts))
        if building is not None:
            yield pack([*ids, current], [*done, building.result()], id_type)

    return ordered.mapInArrow(work, f"conv_id {kind}, {FORMATTED}")


def digests(formatted: DataFrame) -> DataFrame:
    """What reading back a formatted conversation gives: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "n_tokens"]

    def work(batches):
        for batch in batches:
            rows = []
            for key, text, spans, attachments, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[a:b]) for a, b in spans)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((key, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(attachments), tokens))
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, n_tokens bigint"
    return formatted.select("conv_id", "formatted", "spans", "attachments", "n_tokens").mapInArrow(work, schema)


def op1_chat(turns: DataFrame) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return digests(format_conversations(turns.select("conv_id", "turn", "role", "text").unionByName(extra)))


#: DuckDB; turns_sha256 and the loss columns follow from the table, formatted_chars from the template and its escapes.
SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), clean AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM turns
), sized AS (
  SELECT *, length(role) + length(text) + length(regexp_replace(text, '[^\\<]', '', 'g')) + length(regexp_replace(role, '[^\\<>]', '', 'g'))
            + length('<turn >') + 1 + length('</turn>') + 1 AS chars,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM clean
), told AS (
  SELECT conv_id, count(*) AS n_turns,
         coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST), '') AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
         sum(chars) AS chars, sum(words) AS words
  FROM sized GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(words AS BIGINT) AS n_tokens
FROM told
"""
