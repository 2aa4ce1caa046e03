"""Fill-in-middle texts: lines are cut into prefix, middle and suffix, which sentinels then put in another order.

A table-driven automaton reads the bytes of many texts at once: it knows where code points and lines begin and where a
sentinel is complete. Its state after two bytes does not depend on where it began, so two look-ups in the table give the
state before every byte, and a third what that byte emits; sums of these counts are all that the cuts need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, text_column, text_groups

#: The sentinels before prefix, suffix and middle.
SENTINELS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}

#: Classes of bytes, and states of the automaton: at the start of a line, within one, after "<", after "<" and a letter.
NEWLINE, OPEN, LETTER, CLOSE, CONTINUATION, OTHER = range(6)
START, WITHIN, OPENED, LETTERED = range(4)
#: What a byte can emit: a code point begins, a line begins, a sentinel is complete.
CODE_POINT, LINE, SENTINEL = 1, 2, 4


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[0x80:0xC0] = CONTINUATION
    out[ord("\n")], out[ord("<")], out[ord(">")] = NEWLINE, OPEN, CLOSE
    out[[ord(s[1]) for s in SENTINELS.values()]] = LETTER
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each state and byte, the next state and what is emitted."""
    step, emit = np.full((4, 6), WITHIN, np.uint8), np.full((4, 6), CODE_POINT, np.uint8)
    step[:, NEWLINE], step[:, OPEN], step[OPENED, LETTER] = START, OPENED, LETTERED
    emit[:, CONTINUATION] = 0
    emit[START] |= LINE
    emit[LETTERED, CLOSE] |= SENTINEL
    of = _classes()
    return step[:, of], emit[:, of]


STEP, EMIT = _tables()


def emitted(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What each byte emits; texts begin at the starts."""
    before = np.empty(len(data), np.uint8)
    if len(data):
        before[1:] = STEP[START, data[:-1]]
        before[2:] = STEP[before[1:-1], data[1:-1]]
        first = starts[starts < len(data)]
        before[first] = START
        second = first + 1
        second = second[second < len(data)]
        before[second] = STEP[START, data[second - 1]]
        before[first] = START  # where a text has one byte, its second is another's first
    return EMIT[before, data]


def _arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, one, two, whole, suffix_first) to rows of formatted()."""
    for batch in batches:
        for part in text_groups(batch):
            yield _part(part)


def _part(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = raw_texts(batch.column(1))
    begin, end = offsets[:-1], offsets[1:]
    events = emitted(data, begin[end > begin])
    points = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(events & CODE_POINT, out=points[1:])
    at = np.append(np.flatnonzero(events & LINE), len(data))
    marks = np.flatnonzero(events & SENTINEL)
    first, n = np.searchsorted(at, begin), np.searchsorted(at, end) - np.searchsorted(at, begin)
    one, two = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) % (n + 1) for i in (2, 3))
    plain = batch.column(4).to_numpy(zero_copy_only=False).astype(bool) | (end == begin) | (np.searchsorted(marks, end) > np.searchsorted(marks, begin))
    first_suffix = batch.column(5).to_numpy(zero_copy_only=False).astype(bool)
    # The second pass: the byte where the line after so many of a text's begins, or where the text ends.
    cut = lambda k: np.where(k < n, at[np.minimum(first + k, len(at) - 1)], end)
    left, right = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    p, s, m = (SENTINELS[x].encode() for x in ("prefix", "suffix", "middle"))
    raw = data.tobytes()
    out, form = [], []
    for a, x, y, b, whole, swapped in zip(*(v.tolist() for v in (begin, left, right, end, plain, first_suffix))):
        if whole:
            out.append(raw[a:b])
        elif swapped:
            out.append(b"".join((s, raw[y:b], p, raw[a:x], m, raw[x:y])))
        else:
            out.append(b"".join((p, raw[a:x], s, raw[y:b], m, raw[x:y])))
        form.append("plain" if whole else "spm" if swapped else "psm")
    chars = lambda a, b: pa.array(points[b] - points[a], pa.int64(), mask=plain)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), chars(begin, left), chars(left, right), pa.array(out, pa.binary()).cast(pa.string())], names=["own_key", "n", "form", "prefix_chars", "middle_chars", "output"])


def draws(key: Column, seed: int, count: int = 4) -> list[Column]:
    """Numbers below 2 ** 32 from the SHA-256 of seed and key: groups of eight hex digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def formatted(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, suffix_first: int = 50) -> DataFrame:
    """One row for each row of docs: its key, n (lines), form (plain, psm or spm), prefix_chars and middle_chars (code
    points, null if plain) and output.

    Both cuts fall before, between or after lines, by draws from the seed and key. rate and suffix_first are per cent of the
    texts that are cut, and of those whose suffix comes first. Empty texts (null ones are empty) and texts that hold a
    sentinel stay plain. Rows with one key and text come out alike; a null key counts as an empty one. No rows give no rows;
    other columns of docs are not looked at. A text is read in one piece, so a very long one needs some 20 times its size.
    """
    h1, h2, h3, h4 = draws(F.col(key), seed)
    rows = docs.select(F.col(key).alias("own_key"), text_column(text).alias("text"), h1.alias("one"), h2.alias("two"), (h3 % 100 >= rate).alias("whole"), (h4 % 100 < suffix_first).alias("swapped"))
    kind = rows.schema["own_key"].dataType.simpleString()
    out = rows.mapInArrow(_arranged, f"own_key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("own_key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text with a sentinel is plain, so the sentinels of the others are theirs."""
    parts = F.split(output, "|".join(SENTINELS.values()))
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """rows of formatted() with the SHA-256 of the output, and of the text restored from it, in place of the output."""
    return rows.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}).drop("output")
