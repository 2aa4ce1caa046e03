"""Exact duplicates against a dictionary."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ratelens.llm import exact_dedup
from ratelens.llm.common import _kept, mark


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(rows):
    """(id, keep, size, kept, digest) of rows (id, text)."""
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    keep = {x: max((i for i in ids if i is not None), default=None) for x, ids in groups.items()}
    return sorted(((i, keep[low(t)], len(groups[low(t)]), i == keep[low(t)], hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows), key=repr)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15])
def test_groups(documents, odd_texts, bits, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAP_BITS", bits)
    long = "Ab" * 3_000_000
    texts = [*odd_texts, *odd_texts[::3], "É", "é", "ABC", "abc", "aBC", "K", "K", "x" * 64 + "1", "X" * 64 + "1", "x" * 64 + "2", long, long.upper(), long[:-1] + "c", *["hot"] * 500]
    rows = list(enumerate(texts))
    assert found(exact_dedup.exact_groups(documents(texts), digest="text_sha256")) == plain(rows)


def test_hot_groups_stay_where_they_lie(documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_HOT", 3)
    texts = [*["a"] * 50, *["B", "b"] * 2, "c", "c", "d"]
    assert found(exact_dedup.exact_groups(documents(texts), digest="text_sha256")) == plain(list(enumerate(texts)))


def test_odd_rows(spark, documents):
    """Null and repeated keys, clashing names, no rows."""
    rows = [(None, "a"), (None, "A"), (None, "b"), (3, "b"), (3, "b"), (2, None), (1, ""), (4, "z")]
    df = spark.createDataFrame([(i, t, "x", 1, b"y") for i, t in rows], "doc_id long, text string, own_key string, hash int, bits binary")
    assert found(exact_dedup.exact_groups(df, digest="text_sha256")) == plain(rows)
    assert exact_dedup.exact_groups(documents([])).collect() == []
    assert exact_dedup.exact_groups(df).columns == ["doc_id", "keep_id", "group_size", "kept"]


def test_rows_that_stay_keep_their_columns(documents):
    texts = ["a", "A", None, "", "b", "c" * 100, "C" * 100]
    kept = exact_dedup.without_duplicates(documents(texts))
    assert sorted(kept.collect()) == sorted(documents(texts).where(F.col("doc_id").isin(1, 3, 4, 6)).collect())


def test_plan_has_no_python_and_shuffles_no_text(documents):
    plan = exact_dedup.exact_groups(documents(["a"] * 9 + ["b"]), digest="d")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    assert not any("text" in line for line in plan.splitlines() if "Exchange" in line)


def test_tables_of_finished_steps_are_dropped(documents):
    point = mark()
    exact_dedup.exact_groups(documents(["a", "b"]))
    assert len(_kept) - point == 2  # the rows and the groups, which the result reads
