"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=5, positives=5, negatives=3):
    """rows (id, vector, label), ids differing; anchors are ids divisible by every."""
    own = [(i, [math.floor(256 * x) for x in map(float, map(np.float32, v))], c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q, c in own:
        if i % every:
            continue
        score = [(-sum(a * b for a, b in zip(q, v)), j, d) for j, v, d in own if len(v) == len(q)]
        for p, j, _ in sorted(s for s in score if s[2] == c and s[1] != i)[:positives]:
            there = sorted(s for s in score if s[2] != c and -50 * p <= -100 * s[0] <= -95 * p)[:negatives]
            out += [(i, j, n, k, -p, -s) for n, (s, k, _) in enumerate(there, 1)]
    return sorted(out)


def found(spark, rows, every=5, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    out = hard.hard_negatives(df, F.col("vec_id") % every == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def clustered(n, dim, seed, groups=12):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(groups, dim))
    return [(i, (centres[i % groups] + 0.4 * rnd.normal(size=dim)).tolist(), int(i % 4)) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    """Many regions, blocks, shares and buckets."""
    for name, value in {"SAMPLE": 64, "REGIONS": 8, "BLOCK": 20, "QUERIES": 9, "BUCKET": 4}.items():
        monkeypatch.setattr(hard, name, value)


def test_as_it_is(spark):
    rows = clustered(600, 16, 1)
    assert (want := plain(rows)) and found(spark, rows) == want


def test_with_many_regions(spark, small):
    rows = clustered(400, 8, 2)
    assert (want := plain(rows)) and found(spark, rows) == want


def test_copies_and_ties(spark, small):
    """Equal vectors, under one label and under several; scores that tie."""
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([0.5, 1.0, -0.25]) for _ in range(3)], rnd.randint(0, 2)) for i in range(300)]
    rows += [(i, [1.0, 0.5, 0.5], 1) for i in range(300, 450)]
    assert (want := plain(rows)) and found(spark, rows) == want


def test_odd_rows(spark, small):
    inf, nan = math.inf, math.nan
    rows = [(0, [1.0, 1.0], 0), (1, [1.0, 0.9], 0), (2, [0.8, 0.8], 1), (3, None, 0), (4, [1.0, None], 0), (5, [1.0, nan], 0), (6, [inf, 1.0], 1), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 0), (10, [1.0, 1.0, 1.0], 0), (11, [1.0, 1.0, 0.9], 0), (12, [0.7, 0.7, 0.7], 3), (15, [], 1), (16, [], 1), (17, [], 0), (20, [0.0, 0.0], 0), (25, [-1.0, -1.0], 2), (30, [0.0, 0.0], 4)]
    assert (want := plain(rows)) and found(spark, rows) == want
    assert found(spark, []) == []
    assert found(spark, [(5, [1.0], 1)]) == []


def test_repeated_ids_and_large_norms(spark):
    """Of the rows of one id the least takes part; a norm beyond the limit takes none."""
    rows = clustered(80, 4, 4)
    more = [*rows, *rows[:20], (7, [9.0] * 4, 3), (200, [1e30] * 4, 1), (205, [3e38] * 4, 1)]
    assert found(spark, more) == plain(rows)


def test_extra_columns(spark):
    rows = clustered(60, 4, 5)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "dim", "vec", "anchor", "score", "rank")})
    assert sorted(map(tuple, hard.hard_negatives(df, F.col("vec_id") % 5 == 0).collect())) == plain(rows)


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("scale", [1, 1 << 24])
def test_nearest_is_exact(same, scale, monkeypatch):
    monkeypatch.setattr(hard, "BUCKET", 8)
    rnd = np.random.default_rng(6)
    x, q = (rnd.integers(-40, 40, (n, 5)).astype(float) * scale for n in (500, 40))
    own, anchor = (np.column_stack([rnd.integers(0, 3, n), np.arange(n) + 7]) for n in (500, 40))
    low, high = np.full(40, -1000 * scale * scale), rnd.integers(0, 3000, 40) * scale * scale
    a, r, s = hard.nearest(q, anchor, low, high, np.full(40, -hard.BEYOND), x, own, 4, same)
    exact = q.astype(np.int64) @ x.astype(np.int64).T
    for i in range(40):
        want = sorted((-exact[i, j], own[j, 1]) for j in range(500) if low[i] <= exact[i, j] <= high[i] and (own[j, 0] == anchor[i, 0]) == same and (not same or own[j, 1] != anchor[i, 1]))[:4]
        assert sorted((-s[a == i], own[r[a == i], 1])[0].tolist()) == sorted(w[0] for w in want)
        assert sorted(zip((-s[a == i]).tolist(), own[r[a == i], 1].tolist())) == want


def test_buckets_beyond_reach_stay_closed(monkeypatch):
    """Well-separated groups: most rows are never scored."""
    rnd = np.random.default_rng(7)
    x = np.floor(np.repeat(rnd.normal(size=(32, 6)) * 1000, 300, axis=0) + rnd.normal(size=(9600, 6)))
    seen = []
    monkeypatch.setattr(hard, "scores", lambda q, rows, own=hard.scores: (seen.append(len(q) * len(rows)), own(q, rows))[1])
    own = np.column_stack([np.repeat(np.arange(32), 300), np.arange(9600)])
    hard.nearest(x[:20], own[:20], np.full(20, -hard.BEYOND), np.full(20, hard.BEYOND), np.full(20, -hard.BEYOND), x, own, 5, True)
    assert sum(seen) < 0.25 * 20 * 9600
