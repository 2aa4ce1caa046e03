"""Token counts, packing and piece coding against the libraries."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from ratelens.llm import packing, piece_codec, pretokens, token_counts


def test_counts_equal_the_library(documents, odd_texts):
    rows = token_counts.token_counts(documents(odd_texts)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows:
        text = odd_texts[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 2048), text


def test_whole_tokens_are_proved():
    model = token_counts.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    proved = model.proved()
    plain = [w for w in proved[::50] if w.isascii() and w.isalpha() and w.islower()]
    assert len(proved) > 30_000 and all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in plain)


def test_remembered_words_may_be_forgotten(monkeypatch, odd_texts):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    model = token_counts.vocabulary("word_bpe_49k.json")
    few, all_at_once = token_counts.Counter(model, []), token_counts.Counter(model, model.proved())
    texts = [t or "" for t in odd_texts[:80]]
    assert np.concatenate([few.counts([t]) for t in texts]).tolist() == all_at_once.counts(texts).tolist()


def test_extra_columns_and_empty_tables(documents, spark):
    from pyspark.sql import functions as F

    docs = documents(["a b", "a b"], [7, None]).withColumns({"n_tokens": F.lit("x"), "score": F.lit(1), "fp": F.lit(2)})
    assert sorted((r.doc_id is None, r.n_tokens) for r in token_counts.token_counts(docs).collect()) == [(False, 2), (True, 2)]
    for f in (token_counts.token_counts, packing.packed, piece_codec.round_trips):
        assert f(docs.limit(0)).count() == 0


def test_class_table_splits_as_the_library_does():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}'s" for c in [*range(0x800), *range(0x1C80, 0x1C90), *range(0x2000, 0x2100), 0x85, 0xA7CB, 0x10D40]]
    points, bounds = pretokens.codes(texts)
    starts, ends, owner = pretokens.cut(points, bounds, keep_spaces=True)
    mine = defaultdict(list)
    for s, e, o in zip(starts, ends, owner):
        mine[o].append((s - bounds[o], e - bounds[o]))
    for i, text in enumerate(texts):
        assert mine[i] == [x for _, x in library.pre_tokenize_str(text)], text


def test_packing(documents, odd_texts):
    rows = packing.packed(documents(odd_texts).repartition(2), length=256).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in enumerate(odd_texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own, at = sorted(by_doc[i], key=lambda r: r.start), 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    tokens = sum(r.length for r in rows)
    assert len(by_sequence) * 256 < 1.05 * tokens + 2 * 256


def test_plan_is_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(60):
        cuts = np.concatenate([[0], np.cumsum(rng.integers(1, 5, 12))])
        pen = rng.integers(0, 6, 13)
        best = [0.0] + [float("inf")] * 12
        for j in range(1, 13):
            best[j] = pen[j] + min(best[i] + 9 - (cuts[j] - cuts[i]) for i in range(j) if cuts[j] - cuts[i] <= 9)
        chosen = packing.plan(cuts, pen, 9)
        cost = sum(pen[j] + 9 - (cuts[j] - cuts[i]) for i, j in zip([0, *chosen[:-1]], chosen))
        assert chosen[-1] == 12 and cost == best[12]


def test_pieces_equal_the_library(odd_texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    codec = piece_codec.model("piece_bpe_32k.model")
    texts = [t or "" for t in odd_texts] + ["-" * 300, "=" * 77, " " * 50, "▁▁ ▁", "\n \n", "0" * 99]
    ids, offsets = codec.encode(texts)
    for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
        own = ids[a:b].tolist()
        assert own == library.encode(text), text
        assert codec.decode(own) == library.decode(own), text


def test_piece_round_trips(documents, odd_texts):
    docs = documents(odd_texts)
    rows = piece_codec.round_trips(docs).collect()
    assert all(r.round_trip for r in rows if "▁" not in (odd_texts[r.doc_id] or ""))
    back = {r.doc_id: r.text for r in piece_codec.decoded(piece_codec.encoded(docs)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(odd_texts))
