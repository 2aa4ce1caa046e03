"""Removal of byte strings that the corpus repeats, by a distributed prefix-free parse.

A window is a run of LENGTH bytes of one text; a window is repeated if the same bytes also start elsewhere. As in
prefix-free parsing, a rolling hash sets triggers that depend on nearby bytes only: in each window, the leftmost
position with the least hash of GRAM bytes. Consecutive windows with one trigger form a phrase, kept together with the
bytes that its last window reaches ahead, so that the first LENGTH bytes of a suffix that starts at a window never leave
its phrase. Equal windows have equal triggers at equal offsets.

* The parse is the table of phrase places (trigger, phrase, text, offset); of a phrase that follows itself at once (in
  periodic text), a run of places is one row.
* The dictionary is the different phrases; a phrase that occurs twice has only repeated windows, one whose trigger has no
  other place has none.
* Where a trigger has different phrases, the suffix array of these phrases, by prefix doubling down to the depth of a
  window, ranks their windows. Parse and suffix array together give the windows in corpus order: by rank, and among windows
  of one rank by the places of their phrases. A window is repeated if its rank has several dictionary windows, or its
  phrase several places. (Triggers of very many different phrases are sorted over the cluster, by hashes of the windows.)

Texts are handled once for all their copies. Windows, phrases and texts are told apart by 96 to 128 hash bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, MIX, dropped, fresh, heavy_join, odd_numbers, raw_texts, release, run_hashes, spread, text_column, text_groups, text_key, written

#: Bytes of a window, and of the rolling hash that sets triggers.
LENGTH, GRAM = 200, 32
#: A longer text is parsed in parts of so many windows.
SEGMENT = 1 << 21
#: Different phrases of one trigger that a task compares; triggers with more are compared over the cluster.
IN_TASK = 16_384
#: Phrases of whole triggers that a task gathers before it compares them.
GATHERED = 4096

_BYTE, _STEP = odd_numbers(256, 11), odd_numbers(64, 12)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes (a power of two) that start at each position, built by doubling."""
    hashed, n = _BYTE[data], 1
    while n < GRAM:
        m = len(hashed) - n
        hashed = hashed[:m] * _STEP[n.bit_length()] + hashed[n:]
        hashed ^= hashed >> np.uint64(29)
        n *= 2
    hashed *= MIX
    return hashed ^ (hashed >> np.uint64(32))


def triggers(hashed: np.ndarray, width: int) -> np.ndarray:
    """For each window of that many hashes, the leftmost position of the least one."""
    at, low, n = np.arange(len(hashed), dtype=np.int64), hashed, 1
    while 2 * n <= width:
        m = len(low) - n
        right = low[n:] < low[:m]
        low, at = np.where(right, low[n:], low[:m]), np.where(right, at[n:], at[:m])
        n *= 2
    if n < width:
        m = len(low) - (width - n)
        at = np.where(low[width - n :] < low[:m], at[width - n :], at[:m])
    return at


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The parse of texts that lie one after another: (text index, start, windows, times in a row, trigger hash, phrase hash) arrays."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < LENGTH:
        return none
    hashed = gram_hashes(data)
    trigger = triggers(hashed, LENGTH - GRAM + 1)
    sizes = np.diff(offsets)
    last = np.repeat(offsets[1:], sizes)[: len(trigger)]
    at = np.flatnonzero(np.arange(len(trigger)) + LENGTH <= last)
    if not len(at):
        return none
    new = np.append(True, (trigger[at[1:]] != trigger[at[:-1]]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    start, n = at[first], np.diff(np.append(first, len(at)))
    text = np.searchsorted(offsets, start, side="right") - 1
    phrase = run_hashes(data)(start, start + n - 1 + LENGTH) ^ (trigger[start] - start).astype(np.uint64)
    follows = (text[1:] == text[:-1]) & (phrase[1:] == phrase[:-1]) & (start[1:] == start[:-1] + n[:-1])
    first = np.flatnonzero(np.append(True, ~follows))
    times = np.diff(np.append(first, len(text)))
    text, start, n, phrase = text[first], start[first], n[first], phrase[first]
    return text, start - offsets[text], n, times, hashed[trigger[start]], phrase


_PARSE = "gram long, phrase long, k1 long, k2 long, p int, n int, times int, copied boolean"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _PARSE.split(", ")]
    for batch in batches:
        for part in text_groups(batch):
            data, offsets = raw_texts(part.column(2))
            k1, k2, copied = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            if len(part) == 1 and len(data) > SEGMENT:
                jobs = [(a, data[a : a + SEGMENT + LENGTH - 1]) for a in range(0, len(data), SEGMENT)]
                jobs = [(a, d, np.array([0, len(d)])) for a, d in jobs]
            else:
                jobs = [(0, data, offsets)]
            for shift, own, bounds in jobs:
                text, start, n, times, gram, phrase = phrases(own, bounds)
                cols = [gram.view(np.int64), phrase.view(np.int64), k1[text], k2[text], (start + shift).astype(np.int32), n.astype(np.int32), times.astype(np.int32), copied[text]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def _dictionary_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of chosen phrases: rows (text, places) to rows (gram, phrase, n, repeated, hot, bytes)."""
    for batch in batches:
        for part in text_groups(batch):
            rows = []
            for text, places in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist()):
                rows += [(x["gram"], x["phrase"], x["n"], x["repeated"], x["hot"], text[x["p"] : x["p"] + x["n"] - 1 + LENGTH]) for x in places]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20_000]), kinds)], names=["gram", "phrase", "n", "repeated", "hot", "bytes"])


def _places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of phrases of so many windows: which phrase it is of, and its place there."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _windows(blobs: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of each phrase: which phrase it is of, its place there and its hash."""
    data, offsets = raw_texts(blobs)
    owner, place = _places(n)
    start = offsets[:-1][owner] + place
    return owner, place, run_hashes(data)(start, start + LENGTH)


def window_ranks(data: np.ndarray) -> np.ndarray:
    """The rank of the LENGTH bytes from each position among all of them, in lexicographic order; equal bytes have one rank.

    Prefix doubling: the rank to depth 2n follows from the ranks to depth n at a position and n further on. Positions
    fewer than LENGTH bytes before the end get ranks as if zeros followed.
    """

    def ahead(x: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([x[n:], np.zeros(min(n, len(x)), x.dtype)])

    word = data.astype(np.uint64)
    for n in (1, 2, 4):  # eight bytes as one number
        word = (word << np.uint64(8 * n)) | ahead(word, n)
    rank, depth = np.unique(word, return_inverse=True)[1], 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        rank = np.unique(rank * (int(rank.max()) + 1) + ahead(rank, step), return_inverse=True)[1]
        depth += step
    return rank


def _ranges(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rising (owner, place) rows as runs (owner, first place, place behind the last)."""
    new = np.append(True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1))
    first = np.flatnonzero(new)
    return owner[first], place[first], place[np.append(first[1:], len(place)) - 1] + 1


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (gram, phrase, a, b) of windows that several phrases of a trigger share; rows come sorted by trigger."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        gram, phrase, n = (rows.column(i).to_numpy() for i in range(3))
        data, offsets = raw_texts(rows.column(4).combine_chunks())
        owner, place = _places(n)
        rank = window_ranks(data)[offsets[:-1][owner] + place]
        shared = np.bincount(rank)[rank] > 1
        shared &= ~rows.column(3).to_numpy(zero_copy_only=False)[owner]  # all windows of a repeated phrase count anyway
        at = np.flatnonzero(shared)
        o, a, b = _ranges(owner[at], place[at]) if len(at) else (at, at, at)
        return pa.RecordBatch.from_arrays([pa.array(gram[o]), pa.array(phrase[o]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["gram", "phrase", "a", "b"])

    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if len(held) >= GATHERED:
            gram = held.column(0).to_numpy()
            other = np.flatnonzero(gram != gram[-1])
            if len(other):
                yield found(held.slice(0, int(other[-1]) + 1))
                held = held.slice(int(other[-1]) + 1)
    if held is not None and len(held):
        yield found(held)
    release()


def _spread_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), GATHERED):
            part = batch.slice(i, GATHERED)
            gram, phrase, n = (part.column(j).to_numpy() for j in range(3))
            owner, place, hashed = _windows(part.column(4), n)
            yield pa.RecordBatch.from_arrays([pa.array(gram[owner]), pa.array(phrase[owner]), pa.array(place.astype(np.int32)), pa.array(hashed.view(np.int64)), part.column(3).take(pa.array(owner))], names=["gram", "phrase", "a", "window", "repeated"])


def _without_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent rows of one key as one row, in rows sorted by key."""
    held = None
    for batch in batches:
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        copied = batch.column(3).to_numpy(zero_copy_only=False)
        if not len(k1):
            continue
        new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
        first = np.flatnonzero(new)
        many = np.logical_or.reduceat(copied, first) | (np.diff(np.append(first, len(k1))) > 1)
        rows = [pa.array(k1[first]), pa.array(k2[first]), batch.column(2).take(pa.array(first)), pa.array(many)]
        now = pa.RecordBatch.from_arrays(rows, names=["k1", "k2", "text", "copied"])
        if held is not None:
            if held.column(0)[0] == now.column(0)[0] and held.column(1)[0] == now.column(1)[0]:
                many[0] = True
                now = pa.RecordBatch.from_arrays([*rows[:3], pa.array(many)], names=["k1", "k2", "text", "copied"])
            else:
                yield held
        if len(now) > 1:
            yield now.slice(0, len(now) - 1)
        held = now.slice(len(now) - 1)
    if held is not None:
        yield held
    release()


def _copies_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of a batch, so that a text of very many copies reaches its task a few times only."""
    for batch in batches:
        if not len(batch):
            continue
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        order = np.lexsort((k2, k1))
        new = np.append(True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1]))
        first = np.flatnonzero(new)
        at, many = order[first], np.diff(np.append(first, len(k1))) > 1
        rows = batch.take(pa.array(at))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(many)], names=["k1", "k2", "text", "copied"])
    release()


def _named_key(text: Column) -> list[Column]:
    return [k.alias(x) for k, x in zip(text_key(text), ("k1", "k2"))]


_KEPT = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept {}"


def _removed(batches: Iterator[pa.RecordBatch], decoded: bool = False) -> Iterator[pa.RecordBatch]:
    """What is kept of each text: its bytes, or as text the characters that are whole."""
    names = [x.split()[0] for x in _KEPT.split(", ")]
    for batch in batches:
        for part in text_groups(batch):
            rows = []
            for k1, k2, text, copied, runs in zip(*(part.column(i).to_pylist() for i in range(5))):
                text = text.encode()
                keep = np.ones(len(text) + 1, np.int64)
                if copied and len(text) >= LENGTH:
                    keep[:-1] = 0
                elif runs:
                    change = np.zeros(len(text) + 1, np.int64)
                    np.add.at(change, [r["a"] for r in runs], 1)
                    np.add.at(change, [r["b"] - 1 + LENGTH for r in runs], -1)
                    keep = (np.cumsum(change) == 0).astype(np.int64)
                kept = keep[:-1].astype(bool)
                spans = int((~kept & np.append(True, kept[:-1])).sum()) if len(text) else 0
                left = np.frombuffer(text, np.uint8)[kept].tobytes()
                rows.append((k1, k2, len(text), int((~kept).sum()), spans, left.decode("utf-8", "ignore") if decoded else left))
            kinds = [pa.int64()] * 5 + [pa.string() if decoded else pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def kept_texts(docs: DataFrame, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Rows (k1, k2, n_bytes, n_removed, n_spans, kept), one for each different text; k1 and k2 are the text's key.

    kept is binary, or, decoded, a text without the characters that a removal cuts through.
    """
    text = text_column(text_col)
    keyed = docs.select(text.alias("text")).select(*_named_key(F.col("text")), "text")
    few = keyed.mapInArrow(_copies_of_batch, "k1 long, k2 long, text string, copied boolean")
    texts = written(spread(few, "k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(_without_copies, "k1 long, k2 long, text string, copied boolean"))

    parse = written(texts.where(F.octet_length("text") >= LENGTH).mapInArrow(_parsed, _PARSE))
    most = max(1, parse.count() // HEAVY)
    shared = parse.groupBy("gram").agg(F.count("*").alias("rows"), F.sum("times").alias("places"), (F.min("phrase") != F.max("phrase")).alias("mixed"))
    shared = written(shared.where("places > 1").select("gram", "mixed", "rows"))
    places = written(heavy_join(parse, shared.select("gram", "mixed"), ["gram"], shared.where(F.col("rows") > most)))
    dropped(parse, shared)

    entries = places.where("mixed").groupBy("gram", "phrase").agg(((F.sum("times") > 1) | F.max("copied")).alias("repeated"), F.count("*").alias("rows"), F.min(F.struct("k1", "k2", "p", "n")).alias("at"))
    entries = written(entries.select("gram", "phrase", "repeated", "rows", "at.*"))
    hot = entries.groupBy("gram").count().where(F.col("count") > IN_TASK).select("gram", F.lit(True).alias("hot"))
    chosen = entries.join(hot, "gram", "left").groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "phrase", "p", "n", "repeated", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("places"))
    blobs = texts.join(chosen, ["k1", "k2"]).select("text", "places").mapInArrow(_dictionary_texts, "gram long, phrase long, n int, repeated boolean, hot boolean, bytes binary")
    blobs = written(blobs)
    in_task = spread(blobs.where("NOT hot").select("gram", "phrase", "n", "repeated", "bytes"), "gram").sortWithinPartitions("gram", "phrase").mapInArrow(_compared, "gram long, phrase long, a int, b int")
    windows = blobs.where("hot").select("gram", "phrase", "n", "repeated", "bytes").mapInArrow(_spread_windows, "gram long, phrase long, a int, window long, repeated boolean")
    twice = windows.groupBy("gram", "window").count().where("count > 1").select("gram", "window")
    over_cluster = windows.where("NOT repeated").join(twice, ["gram", "window"]).select("gram", "phrase", "a", (F.col("a") + 1).alias("b"))
    whole = entries.where("repeated").select("gram", "phrase", F.lit(0).alias("a"), F.col("n").alias("b"))
    runs = whole.unionByName(in_task).unionByName(over_cluster).groupBy("gram", "phrase").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    runs = written(runs)
    mixed = heavy_join(places.where("mixed AND times = 1").select("gram", "phrase", "k1", "k2", "p"), runs, ["gram", "phrase"], entries.where(F.col("rows") > most))
    mixed = mixed.select("k1", "k2", F.explode(F.transform("runs", lambda r: F.struct((r.a + F.col("p")).alias("a"), (r.b + F.col("p")).alias("b")))).alias("r"))
    plain = places.where("NOT mixed OR times > 1").select("k1", "k2", F.struct(F.col("p").alias("a"), (F.col("p") + F.col("n") * F.col("times")).alias("b")).alias("r"))
    of_text = plain.unionByName(mixed).groupBy("k1", "k2").agg(F.collect_list("r").alias("runs"))
    of_text = written(of_text)
    dropped(places, blobs, entries, runs)
    return texts.join(of_text, ["k1", "k2"], "left").select("k1", "k2", "text", "copied", "runs").mapInArrow(lambda batches: _removed(batches, decoded), _KEPT.format("string" if decoded else "binary"))


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one for each row of docs.

    Removed is each byte that a string of LENGTH bytes covers which also starts anywhere else in the table. A null text
    counts as empty; texts shorter than LENGTH stay whole; repeated rows are texts like any other, so all their copies
    lose what they share; null ids are kept; extra columns are ignored; an empty table gives no rows.
    """
    digests = kept_texts(docs, text_col).select("k1", "k2", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_named_key(text_column(text_col)))
    return ids.join(digests, ["k1", "k2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def with_repeats_removed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs with what is kept of their texts; characters cut through by a removal go as a whole.

    A null text stays null, an empty one empty; a text that is removed as a whole becomes empty. A column n_chars, if there
    is one, is counted anew where the text changed. Repeated rows all lose what they share; all other columns stay,
    whatever their names; an empty table gives no rows.
    """

    k1, k2, kept = fresh(docs, 3)
    found = kept_texts(docs, text_col, decoded=True).select("k1", "k2", "kept").toDF(k1, k2, kept)
    left = F.when(F.col(text_col).isNotNull(), F.col(kept))
    changed = {text_col: left}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(left == F.col(text_col), F.col("n_chars")).otherwise(F.length(left).cast(kind))
    keyed = docs.withColumns(dict(zip((k1, k2), text_key(text_column(text_col)))))
    return keyed.join(found, [k1, k2]).withColumns(changed).select(*docs.columns)
