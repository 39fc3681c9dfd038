"""Chat formatting (operator 3).

A message is a list of typed parts.  A visitor with one method per type flattens them in order:
text parts are escaped, image, audio and document parts become placeholders, and each attachment's
reference, place and expanded token count is recorded.  Turns are framed by control marks:

    <|im_start|>role
    content<|im_end|>

Control strings inside texts are escaped reversibly: every ``<`` + k backslashes + ``|`` gains one
backslash, so no text can hold ``<|``; reading back removes one.  A newline inside a role is written
as the mark ``<|nl|>``.  The loss mask covers the content of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Placeholders of attachment types, and the tokens that one unit of each expands to.
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Placeholder of parts of any other type; they are recorded as attachments of no tokens.
OTHER = "<|other|>"
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
LOSS_ROLES = frozenset({"assistant"})
PART_TYPE = "array<struct<type:string,text:string,ref:string,units:long>>"
SCHEMA = "conv_id long, position long, role string, segment string, content_start int, content_end int, in_loss boolean, attachments array<struct<type:string,ref:string,offset:int,tokens:long>>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


@dataclass
class Flattener:
    """Visits parts in order and gathers the flat content and its attachments."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    size: int = 0

    def add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.size += len(piece)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.add(part.get("text") or "")

    def attach(self, part: dict) -> None:
        kind = part["type"]
        units = 1 if part.get("units") is None else part["units"]
        self.attachments.append({"type": kind, "ref": part.get("ref"), "offset": self.size, "tokens": units * UNIT_TOKENS[kind]})
        self.add(PLACEHOLDER[kind])

    visit_image = visit_audio = visit_document = attach

    def visit_other(self, part: dict) -> None:
        self.attachments.append({"type": part["type"], "ref": part.get("ref"), "offset": self.size, "tokens": 0})
        self.add(OTHER)


def flatten(parts: list[dict]) -> tuple[str, list[dict]]:
    """Content with escaped texts and placeholders; attachments with offsets into it.

    Neighbouring texts are joined before they are escaped, so that a control string that two parts
    form together is escaped too.  Null parts say nothing.
    """
    joined: list[dict] = []
    for part in filter(None, parts):
        if (part.get("type") or "text") == "text" and joined and (joined[-1].get("type") or "text") == "text":
            joined[-1] = {"type": "text", "text": (joined[-1].get("text") or "") + (part.get("text") or "")}
        else:
            joined.append(part)
    visitor = Flattener()
    for part in joined:
        visitor.visit(part | {"text": escape(part.get("text") or "")} if (part.get("type") or "text") == "text" else part)
    return "".join(visitor.pieces), visitor.attachments


def render(role: str, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """One turn's segment, the range of its content, and its attachments with offsets into the segment."""
    content, attachments = flatten(parts)
    head = f"{START}{escape(role).replace(chr(10), NEWLINE)}\n"
    for a in attachments:
        a["offset"] += len(head)
    return f"{head}{content}{END}\n", len(head), len(head) + len(content), attachments


def read(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from formatted text; attachments stay as placeholders."""
    turns, at = [], 0
    while at < len(formatted):
        assert formatted.startswith(START, at), "a turn begins with its mark"
        line, end = formatted.index("\n", at), formatted.index(END, at)
        role = unescape(formatted[at + len(START) : line].replace(NEWLINE, "\n"))
        turns.append((role, unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def format_turns(conversations: DataFrame, parts: str | None = None) -> DataFrame:
    """One row per turn, in each conversation's order, with its formatted segment.

    Input: conv_id, turn, role, and either text or the column that ``parts`` names (an array of typed parts, see PART_TYPE).
    A conversation's formatted text is its segments in order of ``position``.  Turns are ordered by turn
    (null first), then role, then text, so ties have one defined order; repeated rows are turns of their
    own.  Null role or text is empty; a part of an unknown type becomes a placeholder.  Conversations are dealt out by conv_id and sorted by Spark, and the
    kernel holds one turn at a time, so a long conversation needs no more memory than its longest turn.
    """
    content = F.col(parts).cast(PART_TYPE) if parts else F.array(F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        content.alias("parts"),
    )

    def run(batches):
        last, position = (), 0
        for batch in batches:
            rows = []
            for conv, role, parts in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                position = position + 1 if (conv,) == last else 0
                last = (conv,)
                segment, lo, hi, attachments = render(role, parts or [])
                rows.append({"conv_id": conv, "position": position, "role": role, "segment": segment, "content_start": lo, "content_end": hi, "in_loss": role in LOSS_ROLES, "attachments": attachments})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    item = pa.struct([("type", pa.string()), ("ref", pa.string()), ("offset", pa.int32()), ("tokens", pa.int64())])
    arrow = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("segment", pa.string()), ("content_start", pa.int32()), ("content_end", pa.int32()), ("in_loss", pa.bool_()), ("attachments", pa.list_(item))])
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts").mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the segments say, by conversation, in format_turns()'s order; rows in another order raise.

    A conversation is read by one task, a turn at a time, as a digest of all its turns runs through them in order.
    """

    def run(batches):
        state = None  # [conv_id, n_turns, turns hash, loss characters, loss hash, formatted characters]

        def row(s):
            return {"conv_id": s[0], "n_turns": s[1], "turns_sha256": s[2].hexdigest(), "loss_chars": s[3], "loss_sha256": s[4].hexdigest(), "formatted_chars": s[5]}

        for batch in batches:
            done = []
            for conv, segment, lo, hi, loss, position in zip(*(batch.column(k).to_pylist() for k in range(6))):
                new = state is None or state[0] != conv
                if position != (0 if new else state[1]):
                    raise ValueError(f"turn {position} of conversation {conv} is out of order")
                if new:
                    if state is not None:
                        done.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ((role, text),) = read(segment)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if loss:
                    own = unescape(segment[lo:hi])
                    state[3] += len(own)
                    state[4].update(own.encode())
                state[5] += len(segment)
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row(state)], schema=arrow)

    arrow = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return formatted.select("conv_id", "segment", "content_start", "content_end", "in_loss", "position").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
