"""Chat formatting with typed content parts.

A visitor walks the parts of a turn in order: text is escaped, an image, audio
or document part becomes a placeholder and an attachment record with the
number of tokens that it expands to. One formatted fragment comes out for each
turn, so that no conversation is ever gathered; `digest` streams over the
fragments of a conversation in turn order and keeps running hashes only.

The template is `<|turn|>role<|text|>content<|end|>`. In roles and texts a
backslash becomes two, and `<|` becomes `<\\|`, also where its two characters
come from two parts, which reads back exactly.

Defined cases: null text or role is empty; a null part list means one text
part; an unknown part type is kept as an attachment of that type with one
token; turns with equal numbers follow role, then text, with null as empty;
repeated rows are turns of their own; rows with a null conv_id form one
conversation; texts are handled whole, however long; an empty table gives no
rows; other columns are ignored, whatever their names; of a `parts` column of
structs the known fields are read as far as they can be converted, and one of
another shape counts as no part list.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StringType, StructType

from tessera.llm.blocks import bounded_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
FRAGMENT = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)
PLACEHOLDER = re.compile(r"<\|[a-z]+:\d+\|>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Token expansion: image patch side in pixels, audio tokens a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 512
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
FRAGMENT_SCHEMA = "conv_id bigint, turn bigint, role string, text string, fragment string, loss_spans array<struct<start:bigint,length:bigint>>, attachments array<struct<part:int,kind:string,ref:string,start:bigint,tokens:bigint>>, attachment_tokens bigint"
DIGEST_SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, attachment_tokens bigint"


def escape(text: str, before: str = "") -> str:
    """The text where it follows what has been written before: no control string begins in it or runs on into it."""
    out = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return "\\" + out if before.endswith("<") and out.startswith("|") else out


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class PartVisitor:
    """Flattens one turn's parts; `start` is the fragment's length so far."""

    def __init__(self, start: int, trained: bool):
        self.at, self.trained, self.last = start, trained, ""
        self.out: list[str] = []
        self.spans: list[dict] = []
        self.attachments: list[dict] = []

    def visit(self, index: int, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(index, kind, part)

    def emit(self, piece: str) -> int:
        began = self.at
        self.out.append(piece)
        self.at += len(piece)
        self.last = piece[-1:] or self.last
        return began

    def visit_text(self, index: int, kind: str, part: dict) -> None:
        piece = escape(part.get("text") or "", self.last)
        began = self.emit(piece)
        if self.trained and piece:
            self.spans.append({"start": began, "length": len(piece)})

    def attach(self, index: int, kind: str, part: dict, tokens: int) -> None:
        kind = re.sub("[^a-z]", "", kind.lower()) or "other"
        began = self.emit(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append({"part": index, "kind": kind, "ref": part.get("ref"), "start": began, "tokens": tokens})

    def visit_image(self, index: int, kind: str, part: dict) -> None:
        side = [max(1, math.ceil((part.get(x) or 1) / PATCH)) for x in ("width", "height")]
        self.attach(index, kind, part, side[0] * side[1])

    def visit_audio(self, index: int, kind: str, part: dict) -> None:
        self.attach(index, kind, part, max(1, math.ceil((part.get("seconds") or 0) * AUDIO_RATE)))

    def visit_document(self, index: int, kind: str, part: dict) -> None:
        self.attach(index, kind, part, max(1, part.get("pages") or 1) * PAGE_TOKENS)

    def visit_other(self, index: int, kind: str, part: dict) -> None:
        self.attach(index, kind, part, 1)


def format_turn(role: str | None, text: str | None, parts: list[dict] | None = None, trained_role: str = "assistant") -> dict:
    head = TURN + escape(role or "") + TEXT
    visitor = PartVisitor(len(head), role == trained_role)
    for index, part in enumerate(parts if parts is not None else [{"type": "text", "text": text}]):
        visitor.visit(index, part or {})
    return {"fragment": head + "".join(visitor.out) + END, "loss_spans": visitor.spans, "attachments": visitor.attachments, "attachment_tokens": sum(a["tokens"] for a in visitor.attachments)}


def _parts(conversations: DataFrame) -> Column:
    """The part lists under the known fields, whatever shape the column has."""
    kind = next((f.dataType for f in conversations.schema if f.name == "parts"), None)
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType)):
        return F.lit(None).cast(PARTS)
    have = {f.name: f.dataType for f in kind.elementType}
    plain = (StringType, NumericType, BooleanType)

    def field(part: Column, name: str, wanted: str) -> Column:
        found = part[name].cast("string").try_cast(wanted) if isinstance(have.get(name), plain) else F.lit(None).cast(wanted)
        return found.alias(name)

    fields = [f.split(":") for f in PARTS.removeprefix("array<struct<").removesuffix(">>").split(",")]
    return F.transform("parts", lambda part: F.struct(*[field(part, n, k) for n, k in fields]))


def format_turns(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One formatted fragment for each row of (conv_id, turn, role, text[, parts])."""
    bounded_batches(conversations.sparkSession)
    parts = _parts(conversations)
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text", parts.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [row | format_turn(row["role"], row["text"], row.pop("parts"), trained_role) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(done, schema=ARROW_FRAGMENTS)

    return rows.mapInArrow(run, FRAGMENT_SCHEMA)


_span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
_attachment = pa.struct([("part", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())])
ARROW_FRAGMENTS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fragment", pa.string()), ("loss_spans", pa.list_(_span)), ("attachments", pa.list_(_attachment)), ("attachment_tokens", pa.int64())])
ARROW_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("attachment_tokens", pa.int64())])


class _Running:
    """Hashes of one conversation, read back from its fragments as they pass."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.loss, self.chars, self.tokens = conv_id, 0, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, fragment: str, spans: list[dict], tokens: int) -> None:
        for role, content in FRAGMENT.findall(fragment):
            self.turns.update(f"{unescape(role)}\n{unescape(PLACEHOLDER.sub('', content))}\n".encode())
            self.n += 1
        for span in spans:
            text = unescape(fragment[span["start"] : span["start"] + span["length"]])
            self.masked.update(text.encode())
            self.loss += len(text)
        self.chars += len(fragment)
        self.tokens += tokens

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss, "loss_sha256": self.masked.hexdigest(), "formatted_chars": self.chars, "attachment_tokens": self.tokens}


def digest(fragments: DataFrame) -> DataFrame:
    """One row a conversation, read back from its fragments in turn order with constant memory."""
    bounded_batches(fragments.sparkSession)
    ordered = fragments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).select("conv_id", "fragment", "loss_spans", "attachment_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now.conv_id != row["conv_id"]:
                    if now is not None:
                        done.append(now.row())
                    now = _Running(row["conv_id"])
                now.add(row["fragment"], row["loss_spans"], row["attachment_tokens"])
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema=ARROW_DIGEST)
                done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=ARROW_DIGEST)

    return ordered.mapInArrow(run, DIGEST_SCHEMA)
