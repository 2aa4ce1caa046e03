"""Cuts texts into the pre-tokens of byte-level and word-end BPE vocabularies, whole batches at a time in numpy."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import regex
from tokenizers.pre_tokenizers import ByteLevel

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: The endings that both patterns cut off behind an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_STEP = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def classes() -> np.ndarray:
    """The pattern class of each code point."""
    major = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    out = np.full(0x110000, OTHER, np.uint8)
    out[major == "L"], out[major == "N"] = LETTER, NUMBER
    # where the installed Unicode tables differ (letters of the newest versions), the tokenizers library decides
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern, lead in ((LETTER, r"\p{L}", "a"), (NUMBER, r"\p{N}", "1")):
        doubtful = sorted({ord(c) for c in regex.findall(pattern, every)} ^ set(np.flatnonzero(out == kind).tolist()))
        told = ByteLevel(add_prefix_space=False).pre_tokenize_str("\n".join(lead + chr(c) for c in doubtful))
        joined = {a for _, (a, b) in told if b - a >= 2}
        for i, c in enumerate(doubtful):
            out[c] = kind if 3 * i in joined else OTHER
    for m in regex.finditer(r"\p{White_Space}", "".join(map(chr, range(0xD800)))):  # none lies above
        out[ord(m[0])] = SPACE
    return out


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts one after another, and where each text starts and the last ends."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def _endings(points: np.ndarray, last: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the apostrophes at the given places start a cut-off ending, and the ending's length."""
    size = np.zeros(len(at), np.int64)
    for ending in ENDINGS:
        ok = at + len(ending) < last[at] if len(at) else np.zeros(0, bool)
        for i, c in enumerate(ending):
            ok = ok & (points[np.minimum(at + 1 + i, len(points) - 1)] == ord(c))
        size = np.where(ok & (size == 0), 1 + len(ending), size)
    return at[size > 0], size[size > 0]


def cut(points: np.ndarray, bounds: np.ndarray, keep_spaces: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens and the text each is of.

    keep_spaces: as byte-level BPE does (a blank before a word belongs to it, other white space stays); otherwise white
    space is dropped and each number character stands alone.
    """
    n = len(points)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    sizes = np.diff(bounds)
    last = np.repeat(bounds[1:], sizes)
    kind = classes()[points]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 0, kind[:-1]
    first = bounds[:-1][sizes > 0]
    before[first] = 0
    start = kind != before
    space = kind == SPACE
    blank_before = np.zeros(n, bool)
    if keep_spaces:
        final = space.copy()  # white space that something else of the same text follows
        final[:-1] &= ~space[1:]
        final[last == np.arange(1, n + 1)] = False
        start |= final
        blank = final & (points == 32)
        blank_before[1:] = blank[:-1]
        start &= ~blank_before
    else:
        start |= kind == NUMBER
    at = np.flatnonzero((points == 39) & (before != OTHER) & ~blank_before)
    at, size = _endings(points, last, at)
    if len(at):
        start[at] = True
        start[at + 1] = False
        after = at + size
        start[after[after < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    owner = np.repeat(np.arange(len(sizes)), sizes)[starts]
    if not keep_spaces:
        word = ~space[starts]
        starts, ends, owner = starts[word], ends[word], owner[word]
    return starts, ends, owner


def distinct(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The different pre-tokens as strings, and which of them stands at each place (by a 64-bit hash and the length)."""
    if not len(starts):
        return [], np.zeros(0, np.int64)
    total = points.astype(np.uint64) * _STEP
    total ^= total >> np.uint64(31)
    power = np.full(len(points) + 1, np.uint64(0xD1342543DE82EF95))
    power[0] = 1
    np.cumprod(power, out=power)
    total *= power[1:]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(total, dtype=np.uint64)])
    key = (total[ends] - total[starts]) * power[len(points) - starts]
    key = (key ^ (key >> np.uint64(32))) * _STEP + (ends - starts).astype(np.uint64)
    _, index, place = np.unique(key, return_index=True, return_inverse=True)
    flat = points.tobytes()
    a, b = (4 * starts[index]).tolist(), (4 * ends[index]).tolist()
    return [flat[i:j].decode("utf-32-le", "surrogatepass") for i, j in zip(a, b)], place


def lowered(text: str) -> str:
    """Canonical composition, then lower case character by character (a final sigma is not special)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


def around_specials(texts: list[str], specials: tuple[str, ...]) -> tuple[list[str], np.ndarray, list[str | None]]:
    """The texts cut at special strings: the parts, the text each is of, and the special string behind each (or None)."""
    if not any(s in t for s in specials for t in texts):
        return texts, np.arange(len(texts)), [None] * len(texts)
    by = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True))))
    parts, owner, behind = [], [], []
    for i, text in enumerate(texts):
        at = 0
        for m in by.finditer(text):
            parts.append(text[at : m.start()])
            owner.append(i)
            behind.append(m[0])
            at = m.end()
        parts.append(text[at:])
        owner.append(i)
        behind.append(None)
    return parts, np.array(owner), behind


@functools.cache
def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


def in_byte_letters(text: str) -> str:
    letters = byte_letters()
    return "".join([letters[b] for b in text.encode("utf-8", "surrogatepass")])
