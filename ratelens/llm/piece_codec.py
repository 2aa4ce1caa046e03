"""SentencePiece encoding and decoding of BPE models with byte fallback, by suffix-array matching.

A batch's different units (stretches that no vocabulary piece crosses) that are not yet known are laid one after another
and their positions sorted by what follows: a suffix array as deep as the longest piece. A binary search of every piece
gives the range of its occurrences. These ranges, as edges (start, end, piece) sorted by end position, are relaxed from
left to right: an edge holds if its piece and the last piece before it stay apart when the model merges both alone. For
BPE exactly one chain of such edges reaches each position, and it is the model's own segmentation.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import public_path, raw_texts, text_column, text_groups

#: Fixed value: the mark that stands for a blank.
MARK = "▁"
#: Different units that a worker remembers before it starts afresh, and pairs of pieces.
REMEMBERED, PAIRS = 400_000, 3_000_000
#: Characters of new units that are indexed at once.
INDEXED = 1 << 18


class PieceModel:
    """The pieces of a SentencePiece BPE model, its merges, and both directions of coding."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only BPE models without normalisation are read")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
        self.byte_ids = np.array([i for _, i in sorted((int(p.piece[3:5], 16), i) for i, p in enumerate(model.pieces) if p.type == 6)], np.uint32)
        self.raw: list[bytes] = [b""] * len(model.pieces)
        for i, s, _ in normal:
            self.raw[i] = s.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            self.raw[i] = bytes([b])
        by_text = {s: i for i, s, _ in normal}
        rank = {i: k for k, (i, _, _) in enumerate(sorted(normal, key=lambda x: (-x[2], x[0])))}
        letters = sorted({c for s in by_text for c in s})
        #: Numbers of the characters that pieces use; 0 is any other.
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letter_piece = np.array([0, *(by_text.get(c, 0) for c in letters)], np.int64)
        self.joins = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        pairs: dict[tuple[int, int], int] = {}
        for i, s, _ in normal:
            codes = self.number[[ord(c) for c in s]]
            self.joins[codes[:-1], codes[1:]] = True
            for k in range(1, len(s)):
                a, b = by_text.get(s[:k]), by_text.get(s[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        key = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.pair_key = key[order]
        self.pair_new = np.array(list(pairs.values()), np.int64)[order]
        self.pair_rank = np.array([rank[i] for i in pairs.values()], np.int64)[order]
        self.none = len(normal)
        long = [(i, s) for i, s, _ in normal]
        self.piece_id = np.array([i for i, _ in long], np.int64)
        self.length = np.zeros(len(model.pieces), np.int64)
        self.length[self.piece_id] = [len(s) for _, s in long]
        self.depth = -(-int(self.length.max()) // 4) * 4
        self.piece_codes = np.zeros((len(model.pieces), self.depth), np.uint16)
        for i, s in long:
            self.piece_codes[i, : len(s)] = self.number[[ord(c) for c in s]]
        self.low = self._columns(self.piece_codes[self.piece_id])
        high = self.piece_codes[self.piece_id].copy()
        high[np.arange(self.depth)[None] >= self.length[self.piece_id][:, None]] = 0xFFFF
        self.high = self._columns(high)
        self.known: dict[str, np.ndarray] = {}
        self.apart_key, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)
        alone, first, _ = self.merged(self.piece_codes[self.piece_id], self.length[self.piece_id])
        self.whole = np.zeros(len(model.pieces), bool)
        self.whole[self.piece_id[(alone == 1) & (first == self.piece_id)]] = True

    def _columns(self, codes: np.ndarray) -> list[np.ndarray]:
        """Rows of characters as 64-bit columns of four characters each, that sort alike."""
        wide = codes.astype(np.uint64)
        return [(wide[:, i] << np.uint64(48)) | (wide[:, i + 1] << np.uint64(32)) | (wide[:, i + 2] << np.uint64(16)) | wide[:, i + 3] for i in range(0, codes.shape[1], 4)]

    def merged(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the model's merges leave of short strings: the number of pieces, the first and the second."""
        inside = np.arange(codes.shape[1])[None] < lengths[:, None]
        symbol = self.letter_piece[codes[inside]]
        row = np.repeat(np.arange(len(codes)), lengths)
        size, first, second = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64), np.full(len(codes), -1, np.int64)
        while len(symbol):
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            rank = np.append(np.where((self.pair_key[at] == key) & (row[:-1] == row[1:]), self.pair_rank[at], self.none), self.none)
            new = np.append(at, 0)
            heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            count = np.diff(np.append(heads, len(row)))
            best = np.minimum.reduceat(rank, heads)
            done = best == self.none
            size[row[heads[done]]], first[row[heads[done]]] = count[done], symbol[heads[done]]
            two = heads[done & (count > 1)]
            second[row[two]] = symbol[two + 1]
            best = np.repeat(best, count)
            hit = np.flatnonzero((rank == best) & (best < self.none))
            if len(hit) > 1:
                fresh = np.append(True, hit[1:] != hit[:-1] + 1)
                hit = hit[(np.arange(len(hit)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
            symbol[hit] = self.pair_new[new[hit]]
            keep = best < self.none
            keep[hit + 1] = False
            symbol, row = symbol[keep], row[keep]
        return size, first, second

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces, merged alone, stays that pair; answers are remembered."""
        key = left << 32 | right

        def look() -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(self.apart_key, key), max(0, len(self.apart_key) - 1))
            return at, self.apart_key[at] == key if len(self.apart_key) else np.zeros(len(key), bool)

        at, found = look()
        if not found.all():
            new = np.unique(key[~found])
            a, b = new >> 32, new & 0xFFFFFFFF
            codes = np.zeros((len(new), 2 * self.depth), np.uint16)
            la, lb = self.length[a], self.length[b]
            codes[:, : self.depth] = self.piece_codes[a]
            r, c = np.nonzero(np.arange(self.depth)[None] < lb[:, None])
            codes[r, la[r] + c] = self.piece_codes[b[r], c]
            size, first, second = self.merged(codes, la + lb)
            every = np.concatenate([self.apart_key, new])
            answer = np.concatenate([self.apart, (size == 2) & (first == a) & (second == b)])
            order = np.argsort(every, kind="stable")
            self.apart_key, self.apart = every[order], answer[order]
            at, _ = look()
        return self.apart[at]

    def edges(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of pieces in a text of character numbers: (start, piece), by a suffix array."""
        wide = np.concatenate([flat, np.zeros(self.depth, np.uint16)])
        columns = self._columns(np.lib.stride_tricks.sliding_window_view(wide, self.depth)[: len(flat)])
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]

        def place(keys: list[np.ndarray], after: bool) -> np.ndarray:
            low, high = np.zeros(len(self.piece_id), np.int64), np.full(len(self.piece_id), len(order), np.int64)
            while (low < high).any():
                mid = np.minimum((low + high) // 2, len(order) - 1)
                less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
                for column, key in zip(columns, keys):
                    here = column[mid]
                    less |= same & (here < key)
                    same &= here == key
                right = (less | same if after else less) & (low < high)
                low, high = np.where(right, mid + 1, low), np.where(right | (low >= high), high, mid)
            return low

        a, b = place(self.low, False), place(self.high, True)
        n = b - a
        first = np.cumsum(n) - n
        at = np.repeat(a - first, n) + np.arange(int(n.sum()))
        return order[at], np.repeat(self.piece_id, n)

    def segmented(self, units: list[str]) -> list[np.ndarray]:
        """The piece ids of units made of the model's characters."""
        points, bounds = pretokens.codes(units)
        sizes = np.diff(bounds)
        number = self.number[points]
        shift = np.repeat(np.arange(len(units)), sizes)
        flat = np.zeros(len(points) + len(units), np.uint16)
        flat[np.arange(len(points)) + shift] = number  # a zero behind each unit, which no piece holds
        base = bounds[:-1] + np.arange(len(units))
        start, piece = self.edges(flat)
        unit = np.searchsorted(base, start, side="right") - 1
        end = start + self.length[piece]
        offset = end - base[unit]
        order = np.lexsort((unit, offset))
        start, piece, unit, end, offset = start[order], piece[order], unit[order], end[order], offset[order]
        last = np.zeros(len(flat) + 1, np.int64)  # the piece that ends at a position, in the chain from the unit's start
        steps = np.flatnonzero(np.append(True, offset[1:] != offset[:-1])) if len(offset) else np.zeros(0, np.int64)
        for a, b in zip(steps, np.append(steps[1:], len(offset))):
            s, p = start[a:b], piece[a:b]
            first = s == base[unit[a:b]]
            ok = first & self.whole[p]
            inner = np.flatnonzero(~first & (last[s] > 0))
            if len(inner):
                ok[inner] = self.whole[p[inner]] & self.stay_apart(last[s[inner]], p[inner])
            last[end[a:b][ok]] = p[ok]
        out: list[list[int]] = [[] for _ in units]
        at = base + sizes
        live = np.flatnonzero(at > base)
        while len(live):
            p = last[at[live]]
            if not p.all():
                raise AssertionError("no chain of pieces reaches a unit's end")
            for u, x in zip(live.tolist(), p.tolist()):
                out[u].append(x)
            at[live] -= self.length[p]
            live = live[at[live] > base[live]]
        return [np.array(x[::-1], np.uint32) for x in out]

    def unit_ids(self, units: list[str]) -> list[np.ndarray]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        if len(self.apart_key) > PAIRS:
            self.apart_key, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)
        new: list[str] = []
        size = 0

        def learn() -> None:
            known.update(zip(new, self.segmented(new)))
            new.clear()

        for u in units:
            if u in known:
                continue
            if len(u) == 1 and not self.letter_piece[self.number[ord(u)]]:
                known[u] = self.byte_ids[list(u.encode())]
                continue
            new.append(u)
            size += len(u)
            if size > INDEXED:
                learn()
                size = 0
        if new:
            learn()
        return [known[u] for u in units]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offsets of the texts in them."""
        lead = MARK if self.prefix else ""
        points, bounds = pretokens.codes([lead + t.replace(" ", MARK) if t else "" for t in texts])
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        number = self.number[points]
        begin = np.ones(len(points), bool)
        begin[1:] = ~self.joins[number[:-1], number[1:]]
        begin[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(points))
        owner = np.searchsorted(bounds, starts, side="right") - 1
        units, place = pretokens.distinct(points, starts, ends)
        table = self.unit_ids(units)
        size = np.array([len(x) for x in table], np.int64)
        flat, first = np.concatenate(table), np.cumsum(size) - size
        each = size[place]
        end = np.cumsum(each)
        ids = flat[np.repeat(first[place] - (end - each), each) + np.arange(end[-1])]
        per = np.bincount(owner, weights=each, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per)])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: blanks for marks, the leading blank removed, bytes put together (broken ones replaced)."""
        raw = b"".join([self.raw[i] for i in ids])
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


@functools.lru_cache(2)
def model(name: str) -> PieceModel:
    return PieceModel(public_path(name))


def encoded(docs: DataFrame, model_file: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids), ids as an array of int, one for each row of docs.

    A null or empty text has no ids. Null and repeated ids are kept; extra columns are ignored; an empty table gives no
    rows. No shuffle; memory is bounded by the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model(model_file)
        for batch in batches:
            for part in text_groups(batch):
                ids, offsets = codec.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model_file: str = "piece_bpe_32k.model", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, text) of encoded texts; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model(model_file)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


DIGEST = "doc_id long, n_bytes long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def round_trips(docs: DataFrame, model_file: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each text's ids (unsigned 32-bit, little-endian) and of the text decoded from them, one row for each row of docs.

    A null text counts as empty and has no ids. Null and repeated ids and repeated rows are coded like any other; extra
    columns are ignored, whatever their names; an empty table gives no rows. Whole texts are coded; memory follows the
    longest run that no blank ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model(model_file)
        for batch in batches:
            for part in text_groups(batch):
                texts = part.column(1).to_pylist()
                ids, offsets = codec.encode(texts)
                n_bytes = np.diff(raw_texts(part.column(1))[1])
                rows = []
                for text, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = ids[a:b]
                    back = codec.decode(own.tolist())
                    rows.append((b - a, hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text))
                n, ids_sha, text_sha, same = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(same)], names=[x.split()[0] for x in DIGEST.split(", ")])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    return picked.mapInArrow(run, DIGEST)
