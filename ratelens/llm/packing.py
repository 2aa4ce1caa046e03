"""Packing of token streams into fixed-length sequences by order-preserving dynamic programming.

The documents of a partition form one stream of token ids in their order. Sequences are consecutive windows of that
stream. Window cuts are chosen among document ends, sentence ends and, where these lie too far apart, plain positions, so
that padding plus truncation penalties are least. With f(j) the least cost of the stream up to cut j,

    f(j) = penalty(j) + length - j + min over cuts i in [j - length, j) of (f(i) + i)

and the minimum over the sliding range is kept in a monotone queue, so each cut is pushed and popped once. (Windows that
need no padding because their length is a power of two are not sought: full windows pad less and are fewer.)
"""

from __future__ import annotations

import functools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import public_path, text_column, text_groups

#: Cost, in padding tokens, of a sequence that ends within a document at a sentence end, and of one that ends elsewhere.
SENTENCE_CUT, PLAIN_CUT = 2, 12
#: Distance of the plain cut candidates that are laid into stretches without a natural end.
PLAIN_STEP = 64
#: Tokens of the stream that are planned at once; the last windows of a plan are planned again with what follows.
HORIZON = 1 << 18
#: Different pre-tokens whose ids a worker remembers before it starts afresh.
REMEMBERED = 200_000
#: Characters of the longest pre-token that is remembered, which bounds the memory by bytes.
LONGEST = 64


class ByteVocabulary:
    """A byte-level BPE vocabulary that gives whole texts' ids, batch by batch."""

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(pretokens.byte_letters())}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.specials}
        self.core = tiktoken.Encoding("ranks", pat_str=r"\\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.known: dict[str, bytes] = {}

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Each word's ids as 32-bit numbers."""
        known, out = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = np.array(self.core.encode_single_piece(w.encode()), np.uint32).tobytes()
                if len(w) <= LONGEST:
                    known[w] = ids
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after another, the offsets of the texts in them, and which ids end a sentence."""
        parts, owner, behind = pretokens.around_specials(texts, tuple(self.specials))
        points, bounds = pretokens.codes(parts)
        starts, ends, part = pretokens.cut(points, bounds, keep_spaces=True)
        words, place = pretokens.distinct(points, starts, ends)
        table = self.word_ids(words)
        closing = np.array([w[-1] in ".!?\n" for w in words], bool)
        special = [(i, self.specials[b]) for i, b in enumerate(behind) if b is not None]
        if special:  # a special string's id follows the last word of its part
            at = np.searchsorted(part, [i for i, _ in special], side="right")
            place = np.insert(place, at, len(table) + np.arange(len(special)))
            part = np.insert(part, at, [i for i, _ in special])
            table += [np.array([x], np.uint32).tobytes() for _, x in special]
            closing = np.append(closing, np.zeros(len(special), bool))
        if not len(place):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64), np.zeros(0, bool)
        size = np.array([len(x) // 4 for x in table], np.int64)
        flat, first = np.frombuffer(b"".join(table), np.uint32), np.cumsum(size) - size
        each = size[place]
        end = np.cumsum(each)
        ids = flat[np.repeat(first[place] - (end - each), each) + np.arange(end[-1])]
        stops = np.zeros(len(ids), bool)
        stops[end[closing[place]] - 1] = True
        per = np.bincount(owner[part], weights=each, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per)]), stops


@functools.lru_cache(2)
def vocabulary(name: str) -> ByteVocabulary:
    return ByteVocabulary(public_path(name))


def plan(cuts: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Indices of the cuts that end the windows of the cheapest plan.

    cuts: rising stream positions, from the start of the first window to the end of the last; neighbours lie at most
    length apart. Ties go to the earlier start, so equal input gives equal plans.
    """
    at, pen = cuts.tolist(), penalties.tolist()
    n = len(at)
    cost, back = [0] * n, [0] * n
    queue = deque([(at[0], 0)])  # (f(i) + i, i), rising in both
    for j in range(1, n):
        here = at[j]
        while at[queue[0][1]] < here - length:
            queue.popleft()
        best, i = queue[0]
        best += length - here
        cost[j], back[j] = best + pen[j], i
        value = cost[j] + here
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    out, j = [], n - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def candidates(doc_ends: np.ndarray, stops: np.ndarray, total: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions from 0 to total and the penalty of each.

    Natural ends come first; plain positions stand every PLAIN_STEP tokens, so no gap is longer than a window.
    """
    penalty = np.full(total + 1, -1, np.int64)
    penalty[:: min(PLAIN_STEP, length)] = PLAIN_CUT
    penalty[np.flatnonzero(stops) + 1] = SENTENCE_CUT
    penalty[doc_ends] = 0
    penalty[[0, total]] = 0
    cuts = np.flatnonzero(penalty >= 0)
    return cuts, penalty[cuts]


class Packer:
    """Takes documents in order and gives the pieces of finished sequences."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence = length, first_sequence
        self.ids, self.stops = np.zeros(0, np.uint32), np.zeros(0, bool)
        self.docs: list[list[int]] = []  # [doc_id, tokens in all, tokens already placed, tokens still in the stream]
        self.fresh = 0
        self.pending_ids: list[np.ndarray] = []
        self.pending_stops: list[np.ndarray] = []

    def add(self, doc: int | None, ids: np.ndarray, stops: np.ndarray) -> None:
        self.docs.append([doc, len(ids), 0, len(ids)])
        self.pending_ids.append(ids)
        self.pending_stops.append(stops)
        self.fresh += len(ids)

    def pieces(self, finish: bool = False) -> list[tuple]:
        """The pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) that are now certain."""
        if not finish and self.fresh < HORIZON:
            return []
        self.ids = np.concatenate([self.ids, *self.pending_ids])
        self.stops = np.concatenate([self.stops, *self.pending_stops])
        self.pending_ids, self.pending_stops, self.fresh = [], [], 0
        if not len(self.ids):
            return []
        doc_ends = np.cumsum([d[3] for d in self.docs])
        cuts, penalties = candidates(doc_ends, self.stops, len(self.ids), self.length)
        ends = cuts[plan(cuts, penalties, self.length)].tolist()
        if not finish:  # the end of the stream is not known yet: the last windows wait for what follows
            ends = [e for e in ends if e <= len(self.ids) - 4 * self.length]
        out, at, k = [], 0, 0
        raw = self.ids.tobytes()
        for end in ends:
            offset = 0
            while at < end:
                doc = self.docs[k]
                take = min(end - at, doc[3])
                if take:
                    out.append((doc[0], doc[2], take, zlib.crc32(raw[4 * at : 4 * (at + take)]), doc[1], self.sequence, offset))
                doc[2] += take
                doc[3] -= take
                at += take
                offset += take
                if not doc[3]:
                    k += 1
            self.sequence += 1
        self.docs = self.docs[k:]
        self.ids, self.stops = self.ids[at:].copy(), self.stops[at:].copy()
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TYPES = [pa.int64()] * 7
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def packed(docs: DataFrame, vocabulary_file: str = "byte_bpe_50k.json", length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, each an unbroken run of one document's ids in one sequence.

    A null or empty text is the end id alone. Rows with a null or repeated id are packed like any other; extra columns
    are ignored, whatever their names; an empty table gives no rows. Texts of any length are cut, never shortened. Each partition is
    one stream, so at most its last sequence is short; sequence ids start at partition * 2^40. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(vocabulary_file)
        packer = Packer(length, TaskContext.get().partitionId() << 40)
        tail = np.array([end_id], np.uint32)

        def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), _TYPES)], names=_NAMES)

        for batch in batches:
            for part in text_groups(batch):
                ids, offsets, stops = model.encode(part.column(1).to_pylist())
                for doc, a, b in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    packer.add(doc, np.concatenate([ids[a:b], tail]), np.append(stops[a:b], True))
                yield from rows(packer.pieces())
        yield from rows(packer.pieces(finish=True))

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    return picked.mapInArrow(run, PIECES)
