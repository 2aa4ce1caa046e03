"""Chat formatting: typed content parts flattened by a visitor, turns marked by a reversible template, loss spans kept."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, text_column

#: The template's control strings. Every one starts with the opening that texts can't hold once escaped.
START, END = "<|im_start|>", "<|im_end|>"
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """The text without any control opening: one backslash more in each '<', backslashes, '|'."""
    return _PLAIN.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


@dataclass(frozen=True)
class TokenCosts:
    """How many tokens an attachment stands for once a model expands its placeholder."""

    image_patch: int = 28  # pixels a side for one token
    audio_ms: int = 40  # milliseconds for one token
    document_page: int = 256  # tokens a page


@dataclass
class Flattener:
    """Visits typed parts in order; texts are escaped, every other part becomes a numbered placeholder.

    A part of a type that no method visits becomes a placeholder "other" of one token, its type kept with the attachment.
    """

    costs: TokenCosts = field(default_factory=TokenCosts)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> str:
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        return method(part) if method else self._placeholder(part | {"ref": part.get("ref") or kind}, "other", 1)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        side = self.costs.image_patch
        return self._placeholder(part, "image", math.ceil((part.get("width") or side) / side) * math.ceil((part.get("height") or side) / side))

    def visit_audio(self, part: dict) -> str:
        return self._placeholder(part, "audio", math.ceil((part.get("milliseconds") or 0) / self.costs.audio_ms))

    def visit_document(self, part: dict) -> str:
        return self._placeholder(part, "document", (part.get("pages") or 1) * self.costs.document_page)

    def _placeholder(self, part: dict, kind: str, tokens: int) -> str:
        number = len(self.attachments)
        self.attachments.append({"number": number, "kind": kind, "ref": part.get("ref"), "tokens": max(1, tokens)})
        return f"<|{kind}:{number}|>"


def format_chat(turns: list[tuple[str, list[dict]]], costs: TokenCosts | None = None) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """The formatted conversation, the loss spans (offsets of what the assistant says) and the attachments."""
    flat = Flattener(costs or TokenCosts())
    out, at, loss = [], 0, []
    for role, parts in turns:
        head = f"{START}{_role(role)}\n"
        body = "".join(flat.visit(p) for p in parts)
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        piece = f"{head}{body}{END}\n"
        out.append(piece)
        at += len(piece)
    return "".join(out), loss, flat.attachments


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation (placeholders stay in the texts)."""
    turns = []
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("a turn must begin with its mark")
        stop = formatted.index(END + "\n", at)
        role, _, text = formatted[at + len(START) : stop].partition("\n")
        turns.append((_role_back(role), unescape(text)))
        at = stop + len(END) + 1
    return turns


FORMATTED = "conv_id long, formatted string, loss array<struct<start:int,stop:int>>, attachments array<struct<number:int,kind:string,ref:string,tokens:int>>, expanded_tokens long"
_KINDS = [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())])), pa.int64()]


def formatted_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row for each conversation: formatted text, loss spans, attachments and the tokens these expand to.

    rows: one for each turn, with a text or an array of typed parts (struct with type, text, ref, width, height,
    milliseconds, pages). Turns stand by turn number, then role, then text; repeated rows are turns of their own. Null
    texts and roles count as empty, a null conv_id is a conversation of its own, extra columns are ignored, an empty
    table gives no rows. Rows are sorted and streamed, so a task holds one conversation at a time, which is one row of
    the result.
    """
    content = F.col(parts_col) if parts_col else text_column(text_col)
    picked = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), content.alias("content"))
    order = ["conv_id", "turn", "role"] + ([] if parts_col else ["content"])
    dealt = spread(picked, "conv_id").sortWithinPartitions(*order)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, chars = [], 0
        for conv, own in groupby(turns(batches), key=lambda t: t[0]):
            text, loss, attached = format_chat([(role, [{"type": "text", "text": c}] if isinstance(c, str) else (c or [])) for _, role, c in own])
            found.append((conv, text, [{"start": a, "stop": b} for a, b in loss], attached, sum(a["tokens"] for a in attached)))
            chars += len(text)
            if chars > 1 << 21:
                yield _batch(found)
                found, chars = [], 0
        if found:
            yield _batch(found)

    return dealt.mapInArrow(run, FORMATTED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=["conv_id", "formatted", "loss", "attachments", "expanded_tokens"])


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def chat_digests(chats: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read back from the formatted text and its loss spans alone.

    chats: the rows of formatted_chats(), which says what nulls, ties and repeated rows become. A conversation without an
    assistant has no loss characters and the digest of the empty text; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                turns = parse_chat(text)
                said = "".join(unescape(text[s["start"] : s["stop"]]) for s in loss)
                every = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((conv, len(turns), every, len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, kinds)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return chats.select("conv_id", "formatted", "loss").mapInArrow(run, DIGEST)
