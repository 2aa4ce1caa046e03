"""Token counts of whole texts by the whole-token shortcut.

Method: of every vocabulary string it is proved once, on the driver, whether the vocabulary's merges lead from its
characters to that one token when it stands alone. Pre-tokens found among the proved strings count one token each
without any merging; only the rest are merged (each different one once, kept in a bounded table).
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import public_path, raw_texts, text_column, text_groups

#: Different merged pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Characters of the longest word that is remembered, which bounds the memory by bytes.
LONGEST = 64


class WordVocabulary:
    """A BPE vocabulary with word ends: merge ranks, special strings and the counting of tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = tuple(t["content"] for t in spec["added_tokens"])
        model = spec["model"]
        self.vocabulary = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ids = {s: i for i, s in enumerate(dict.fromkeys([*self.vocabulary, *(a + b for a, b in pairs)]))}
        key = np.array([self.ids[a] * (1 << 32) + self.ids[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], np.arange(len(pairs))[order]
        self.pair_new = np.array([self.ids[a + b] for a, b in pairs], np.int64)

    def symbols(self, word: str) -> list[int]:
        letters = list(pretokens.in_byte_letters(word))
        if letters:
            letters[-1] += self.end
        return [self.ids[x] for x in letters]

    def merged_sizes(self, words: list[str]) -> np.ndarray:
        """How many tokens the merges leave of each word: all words advance together, one lowest-ranked pair a round."""
        size = np.zeros(len(words), np.int64)
        parts = [self.symbols(w) for w in words]
        lengths = np.array([len(p) for p in parts], np.int64)
        symbol = np.array([s for p in parts for s in p], np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        none = len(self.pair_new)
        while len(symbol):
            key = symbol[:-1] * (1 << 32) + symbol[1:]
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            rank = np.where((self.pair_key[at] == key) & (word[:-1] == word[1:]), self.pair_rank[at], none)
            rank = np.append(rank, none)
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, heads)
            count = np.diff(np.append(heads, len(word)))
            done = best == none
            size[word[heads[done]]] = count[done]
            best = np.repeat(best, count)
            hit = np.flatnonzero((rank == best) & (best < none))
            if len(hit) > 1:  # of equal pairs that overlap, every second one from the left
                fresh = np.append(True, hit[1:] != hit[:-1] + 1)
                run = np.arange(len(hit)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                hit = hit[run % 2 == 0]
            symbol[hit] = self.pair_new[rank[hit]]
            keep = best < none
            keep[hit + 1] = False
            symbol, word = symbol[keep], word[keep]
        return size

    def proved(self) -> list[str]:
        """Vocabulary strings that are word tokens and encode, alone, as exactly one token."""
        byte_of = {c: b for b, c in enumerate(pretokens.byte_letters())}
        found = []
        for s in self.vocabulary:
            body = s[: -len(self.end)] if self.end and s.endswith(self.end) else None
            if body and all(c in byte_of for c in body):
                try:
                    found.append(bytes(byte_of[c] for c in body).decode())
                except UnicodeDecodeError:
                    continue
        return [w for w, n in zip(found, self.merged_sizes(found).tolist()) if n == 1]


@functools.lru_cache(2)
def vocabulary(name: str) -> WordVocabulary:
    return WordVocabulary(public_path(name))


class Counter:
    """Counts the tokens of texts: proved strings first, merges for the rest."""

    def __init__(self, model: WordVocabulary, whole: list[str]):
        self.model, self.whole, self.known = model, whole, dict.fromkeys(whole, 1)

    def lengths(self, words: list[str]) -> np.ndarray:
        out = [self.known.get(w) for w in words]
        rest = [w for w, n in zip(words, out) if n is None]
        if rest:
            found = self.model.merged_sizes(rest).tolist()
            short = [(w, n) for w, n in zip(rest, found) if len(w) <= LONGEST]
            if len(self.known) + len(short) > REMEMBERED + len(self.whole):
                self.known = dict.fromkeys(self.whole, 1)
            self.known.update(short)
            more = iter(found)
            out = [next(more) if n is None else n for n in out]
        return np.array(out, np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        parts, owner, behind = pretokens.around_specials(texts, self.model.specials)
        points, bounds = pretokens.codes([pretokens.lowered(t) for t in parts])
        starts, ends, part = pretokens.cut(points, bounds, keep_spaces=False)
        words, place = pretokens.distinct(points, starts, ends)
        each = self.lengths(words)[place] if words else np.zeros(0, np.int64)
        out = np.bincount(owner[part], weights=each, minlength=len(texts)).astype(np.int64) if len(part) else np.zeros(len(texts), np.int64)
        special = np.array([b is not None for b in behind], bool)
        return out + np.bincount(owner[special], minlength=len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, vocabulary_file: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of docs.

    A null text counts as empty: 0 bytes, 0 tokens. Null or repeated ids are kept as they are; other columns are
    ignored, whatever their names; an empty table gives no rows. One pass, no shuffle; memory is bounded by the
    longest text. The broadcast is the list of proved strings, at most as long as the vocabulary.
    """
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(vocabulary(vocabulary_file).proved())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(vocabulary_file), whole.value)
        for batch in batches:
            for part in text_groups(batch):
                texts = part.column(1).to_pylist()
                n = counter.counts(texts)
                n_bytes = np.diff(raw_texts(part.column(1))[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
