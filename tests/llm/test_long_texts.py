"""One text of millions of characters among small ones, through every operator of texts."""

import hashlib
import random
import zlib

import pytest
import tokenizers
from pyspark.sql import functions as F

from ratelens.llm import exact_dedup, fill_in_middle, media_columns, packing, piece_codec, quality_lm, repeat_removal, simhash_dedup, token_counts, toxicity
from ratelens.llm.common import public_path


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(12)
    stock = ["".join(rnd.choice(["ka", "lo", "mi", "né", "ster", "tion", "漢"]) for _ in range(rnd.randint(1, 4))) for _ in range(5000)]
    prose = lambda n: " ".join(rnd.choice(stock) + ("\n" if rnd.random() < 0.05 else "") for _ in range(n))
    long, passage = prose(600_000), prose(60)
    assert len(long.encode()) > 4_000_000
    small = [prose(rnd.randint(5, 200)) for _ in range(40)]
    return [long + passage, *small[:20], small[0] + passage, *small[20:], long + passage]


@pytest.fixture
def docs(documents, texts):
    return documents(texts).withColumn("source", F.lit("hot"))


def test_tokens(docs, texts):
    own = tokenizers.Tokenizer.from_file(public_path("word_bpe_49k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    for i in (0, 1, 21):
        assert got[i] == len(own.encode(texts[i], add_special_tokens=False).ids)
    assert got[len(texts) - 1] == got[0]


def test_pieces(docs, texts):
    rows = piece_codec.round_trips(docs).collect()
    assert len(rows) == len(texts) and len({r.doc_id for r in rows}) == len(texts)


def test_packing(docs, texts):
    own = tokenizers.Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    rows = packing.packed(docs).collect()
    for i in (0, 21):
        pieces = sorted((r.start, r.length) for r in rows if r.doc_id == i)
        total = len(own.encode(texts[i], add_special_tokens=False).ids) + 1
        assert [s for s, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) == total


def test_duplicates(docs, texts):
    last = len(texts) - 1
    exact = {r.doc_id: r for r in exact_dedup.exact_groups(docs, digest="d").collect()}
    assert (exact[0].keep_id, exact[0].group_size, exact[0].kept, exact[last].kept) == (last, 2, False, True)
    assert {r.component_id for r in simhash_dedup.simhash_components(docs).where(F.col("doc_id").isin(0, last)).collect()} == {0}
    repeats = {r.doc_id: r for r in repeat_removal.repeats_removed(docs).collect()}
    assert repeats[0].n_removed == repeats[last].n_removed == len(texts[0].encode()) and repeats[21].n_removed >= len(texts[21].encode()) - len(texts[1].encode()) - 1


def test_media_and_fill(docs, texts):
    payload = media_columns.payload_of(texts[0].encode())
    row = media_columns.media_digests(media_columns.stored_media(docs)).where("doc_id = 0").first()
    assert (row.payload_sha256, row.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    row = fill_in_middle.digests(fill_in_middle.formatted(docs)).where("doc_id = 0").first()
    assert row.restored_sha256 == hashlib.sha256(texts[0].encode()).hexdigest() and row.n == texts[0].count("\n") + (not texts[0].endswith("\n"))


def test_models(spark, docs, texts):
    labels = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    rows = quality_lm.quality(docs, labels).collect()
    assert len(rows) == len(texts) and {r.doc_id for r in rows} == set(range(len(texts)))
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
