"""Ranks, medians, samples, schedules and ordered checks in groups of any size, against plain versions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from ratelens import shared
from ratelens.operators import design, integrity, order, progress


@pytest.fixture(scope="module")
def rows(spark):
    """One long group, some short ones, a null one; most values null or equal."""
    rnd = random.Random(1)
    data = [(rnd.choice(["long"] * 20 + ["a", "b", None]), rnd.choice([None] * 5 + [1.0] * 4 + [rnd.random()]), i) for i in range(3000)]
    return data, spark.createDataFrame(data, "g string, v double, i int").repartition(7).cache()


def test_ranks(rows):
    data, df = rows
    got = {r.i: (r.place, r.all) for r in order.ranked(df, ["g"], [F.desc("i")], "place", "all").collect()}
    for g in {r[0] for r in data}:
        own = sorted((r[2] for r in data if r[0] == g), reverse=True)
        assert all(got[i] == (n, len(own)) for n, i in enumerate(own, 1))
    assert sorted(r.place for r in order.ranked(df, [], ["i"], "place").collect()) == list(range(1, 3001))
    assert order.ranked(df.limit(0), ["g"], ["i"], "place").count() == 0


def test_running_sums(rows):
    data, df = rows
    got = {r.i: (r.up_to, r.all) for r in order.running(df.withColumn("w", F.col("i") % 5), ["g"], ["i"], "w", "up_to", "all").collect()}
    for g in {r[0] for r in data}:
        total, own = 0, sorted(r[2] for r in data if r[0] == g)
        for i in own:
            total += i % 5
            assert got[i] == (total, sum(j % 5 for j in own))


def test_places_of_frequent_and_missing_values(rows):
    data, df = rows
    got = {r.i: (r._place, r._known) for r in design.placed(df, ["g"], "v", ["i"]).collect()}
    for g in {r[0] for r in data}:
        own = sorted((v, i) for h, v, i in data if h == g and v is not None)
        assert all(got[i] == (n, len(own)) for n, (_, i) in enumerate(own, 1))
    assert all(got[i] == (None, None) for _, v, i in data if v is None)


def test_a_frequent_value_is_dealt_out(spark):
    """No partition of the ranked rows holds more than its share, though all rows are of one group and nine in ten lack the value."""
    df = spark.range(40_000).select(F.lit("g").alias("g"), F.when(F.col("id") % 10 == 0, 1.0).alias("v"), F.col("id"))
    sizes = [r["count"] for r in order._dealt(df.withColumn("lost", F.col("v").isNull()), ["g", "lost"], ["v", "id"]).groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 40_000 / 4


def test_medians(spark, rows):
    data, df = rows
    counts = df.where("v IS NOT NULL").groupBy("g", "v").count()
    got = {r.g: r.m for r in order.exact_medians(counts, ["g"], "v", "count", "m").collect()}
    for g in {r[0] for r in data}:
        own = [v for h, v, _ in data if h == g and v is not None]
        assert got.get(g) == (pytest.approx(statistics.median(own)) if own else None)


@pytest.mark.parametrize("digits", [1, 4])
def test_first_drawn_equals_a_sort(spark, rows, digits):
    data, df = rows
    quota = spark.createDataFrame([("long", 137), ("a", 0), ("b", 10_000), (None, 3)], "g string, k long")
    draw = design.shuffled(3, "i")
    drawn = {r.i: r.d for r in df.select("i", draw.alias("d")).collect()}
    got = {r.i for r in order.first_drawn(df, ["g"], draw, quota, "k", digits).collect()}
    want = set()
    for g, k in quota.collect():
        want |= set(sorted((r[2] for r in data if r[0] == g), key=drawn.get)[:k])
    assert got == want


def checked(spark, items, gap):
    """The schedule of items (rater, clip), held against its rules."""
    df = spark.createDataFrame([(r, f"{r}-{n}", c) for n, (r, c) in enumerate(items)], "annotator_code string, assignment_uuid string, clip_id int")
    needs = {r.rater: r for r in design.schedule_needs(df, gap).collect()}
    out = design.scheduled(df, gap).collect()
    assert sorted((r.annotator_code, r.assignment_uuid, r.clip_id) for r in out) == sorted(map(tuple, df.collect()))
    for rater, need in needs.items():
        own = sorted((r for r in out if r.annotator_code == rater), key=lambda r: (r.position is None, r.position))
        if need.feasible:
            assert [r.position for r in own] == list(range(1, len(own) + 1))
            clips = [r.clip_id for r in own]
            assert all(clips[i] not in clips[max(0, i - gap) : i] for i in range(len(clips))), (gap, clips)
        else:
            assert all(r.position is None for r in own)
    return needs


def test_schedules_of_many_shapes(spark):
    rnd = random.Random(4)
    items, shapes = [], {}
    for n in range(120):
        clips = rnd.randint(1, 14)
        counts = [rnd.choice([1, 2, 3, 3, 5, 8]) for _ in range(clips)]
        shapes[f"R{n:03d}"] = counts
        items += [(f"R{n:03d}", c) for c, k in enumerate(counts) for _ in range(k)]
    for gap in (0, 1, 3, 9):
        needs = checked(spark, items, gap)
        for rater, counts in shapes.items():
            top = max(counts)
            assert needs[rater].feasible == ((top - 1) * (gap + 1) + counts.count(top) <= sum(counts))
        assert gap in (0, 9) or {True, False} == {r.feasible for r in needs.values()}


def test_what_is_infeasible_has_no_schedule_at_all(spark):
    """The test from counts against a search through all orders of small lists."""
    from itertools import permutations

    for items in (["a", "a"], ["a", "a", "b"], ["a", "a", "b", "b"], ["a", "a", "a", "b", "b", "c"], ["a", "a", "b", "b", "c"], ["a", "b"]):
        for gap in (1, 2):
            possible = any(all(p[i] not in p[max(0, i - gap) : i] for i in range(len(p))) for p in set(permutations(items)))
            need = design.schedule_needs(spark.createDataFrame([("R", ord(x)) for x in items], "annotator_code string, clip_id int"), gap).first()
            assert need.feasible == possible, (items, gap)


def test_one_rater_with_many_items(spark):
    """A hundred thousand items of one rater, by JVM functions only."""
    df = spark.range(100_000).select(F.lit("R").alias("annotator_code"), F.col("id").cast("string").alias("assignment_uuid"), (F.col("id") % 6151).alias("clip_id"))
    out = design.scheduled(df, 9)
    assert not any(w in out._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))
    assert out.agg(F.count_distinct("position"), F.min("position"), F.max("position")).first()[:] == (100_000, 1, 100_000)
    assert integrity.gap_violations(out, "annotator_code", "clip_id", ["position"], 9, block=1000).count() == 0
    assert integrity.gap_violations(out, "annotator_code", "clip_id", ["position"], 7000, block=1000).count() == 1


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_gap_violations_across_blocks(spark, block):
    rnd = random.Random(6)
    data = [(rnd.choice("AB"), rnd.randint(0, 9), n) for n in range(400)]
    df = spark.createDataFrame(data, "r string, c int, n int")
    got = sorted((r.r, r.position, r.previous) for r in integrity.gap_violations(df, "r", "c", ["n"], 4, first_only=False, block=block).collect())
    want = []
    for rater in "AB":
        clips = [c for r, c, _ in sorted(data, key=lambda x: x[2]) if r == rater]
        for i, c in enumerate(clips):
            before = [j for j in range(i) if clips[j] == c]
            if before and i - before[-1] <= 4:
                want.append((rater, i + 1, before[-1] + 1))
    assert got == sorted(want)
    first = {(r.r, r.position) for r in integrity.gap_violations(df, "r", "c", ["n"], 4, block=block).collect()}
    assert first == {min((w[0], w[1]) for w in want if w[0] == x) for x in "AB"}


@pytest.mark.parametrize("block", [1, 5, 1 << 16])
def test_active_time_across_blocks(spark, block):
    rnd = random.Random(7)
    data = [(rnd.choice("AAAB"), rnd.randint(0, 50) * 1000 * n, rnd.random() < 0.8, n) for n in range(300)]
    df = spark.createDataFrame(data, "u string, at long, visible boolean, n int")
    got = {r.u: r.active_ms for r in progress.active_time(df, "u", F.col("at"), F.col("visible"), 60_000, ("n",), block).collect()}
    for u in "AB":
        own = sorted((at, n, v) for x, at, v, n in data if x == u)
        assert got[u] == sum(min(b[0] - a[0], 60_000) for a, b in zip(own, own[1:]) if a[2])


def test_probes(spark):
    df = spark.createDataFrame([("A", i) for i in range(9)] + [("B", 1), ("C", 1), ("C", 2)], "k string, n int")
    assert sorted(map(tuple, progress.probes(df, "k", "n").collect())) == [("A", 0), ("A", 4), ("A", 8), ("B", 1), ("C", 1), ("C", 2)]


@pytest.mark.parametrize("block", [1, 40, 1 << 16])
def test_schedules_deal_items_without_writing_them(spark, block):
    """Only counts are written, and bins of large clips don't change the schedule; nulls are raters and clips too."""
    rater = F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 3)
    clip = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 5 < 3, F.lit(1)).otherwise(F.col("id") % 40)
    df = spark.range(2000).select(rater.alias("annotator_code"), F.col("id").cast("string").alias("assignment_uuid"), clip.alias("clip_id"))
    point = shared.mark()
    out = design.scheduled(df, 0, block=block)
    assert all("item" not in spark.read.parquet(path).columns for path in shared._kept[point:])
    rows = out.collect()
    assert sorted((r.annotator_code is None, r.annotator_code, r.assignment_uuid, r.clip_id) for r in rows if r.annotator_code is not None) == sorted((False, *r) for r in df.collect() if r.annotator_code is not None)
    for own in (None, 0, 1, 2):
        places = sorted(r.position for r in rows if r.annotator_code == own)
        assert places == list(range(1, len(places) + 1)) and places
    assert {(r.assignment_uuid, r.position) for r in rows} == {(r.assignment_uuid, r.position) for r in design.scheduled(df, 0).collect()}


def test_gap_violations_of_given_places(spark):
    """Places are taken as they are; what has none is not looked at."""
    df = spark.createDataFrame([("A", 1, 1), ("A", 1, 4), ("A", 2, None), ("A", 2, None), ("B", 3, 5), ("B", 3, 6), ("B", 3, 6)], "r string, c int, position int")
    got = sorted((r.r, r.position, r.previous) for r in integrity.gap_violations_of_placed(df, "r", "c", 2, first_only=False, block=4).collect())
    assert got == [("B", 6, 5), ("B", 6, 6)]
