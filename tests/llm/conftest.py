import json
import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of texts with ids from 0."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Texts of all kinds: null, empty, blank, long, repeated, with special strings and many scripts."""
    rnd = random.Random(5)
    bits = ["'s", "'t", "'re", "'ll", "'", "  ", "\n", "\t", "a", "Σ", "ΑΣ", "é", "é", "1", "½", "!", "?!", "<|endoftext|>", "<|startoftext|>", "漢字", "​", "　", "İ", "ſ", "🙂", "S", "\x00", "\x1c", "don't", "▁", "<s>", "<0x0A>", "the ", "ing", "tion"]
    fuzz = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    words = ["".join(rnd.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rnd.randint(1, 4))) for _ in range(500)]
    prose = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 300))) + "." for _ in range(60)]
    return [None, "", " ", "\n\n", "a" * 5000, "a b " * 3000, *fuzz, *prose, prose[0], prose[0], json.dumps({"a": prose[1]})]
