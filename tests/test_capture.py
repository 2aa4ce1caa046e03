"""States of assignments from events: the batch operator, the stream and the study's own operators agree."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ratelens import schemas as S
from ratelens.operators import capture, exchange, progress
from ratelens.streaming import states

NOW = datetime(2026, 1, 1)


def log(seed, assignments=12, length=40, kinds=("opened", "activity", "draft", "submitted", "reset"), days=2):
    rnd = random.Random(seed)
    rows = []
    for a in range(assignments):
        at = NOW
        for n in range(rnd.randint(1, length)):
            at += timedelta(milliseconds=rnd.choice([0, 5, 900, 30_000, 90_000, days * 3_600_000]))
            kind = rnd.choice(kinds) if rnd.random() > 0.2 else "activity"
            if kind == "reset" and rnd.random() < 0.7:
                kind = "draft"
            rows.append((f"e{a}-{n:03d}", f"a{a}", kind, at, rnd.random() < 0.8, f"p{n}" if kind == "draft" else None, rnd.choice(["Fear", "Neutral", "Joy", None]), rnd.choice([0, 3, 9, None]), rnd.choice([None, -5, 700, 10**10])))
    return rows


def plain(rows):
    """The states by a walk through the ordered events of each assignment."""
    out = {}
    for a in {r[1] for r in rows}:
        status, started, done, rating, draft, rejected, active, before = "pending", None, None, (None, None, None), None, 0, 0, None
        for e, _, kind, at, visible, payload, category, intensity, ms in sorted({r for r in rows if r[1] == a}, key=lambda r: (r[3], r[0])):
            if kind == "reset":
                status, started, done, rating, draft, rejected, active, before = "pending", None, None, (None, None, None), None, 0, 0, None
                continue
            if before and before[1]:
                active += min(int((at - NOW) / timedelta(milliseconds=1)) - before[0], 60_000)
            before = (int((at - NOW) / timedelta(milliseconds=1)), visible)
            if kind == "opened" and status == "pending":
                status, started = "started", at
            if kind == "draft":
                draft = payload
            if kind == "submitted":
                if (category, intensity) in (("Fear", 3), ("Neutral", 0)):
                    status, done, draft, rating = "complete", at, None, (None if ms is None else max(0, min(ms, S.DAY_MS)), category, intensity)
                else:
                    rejected += 1
        out[a] = (status, started, done, *rating, draft, rejected, active)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, capture.EVENTS)


@pytest.mark.parametrize("seed", range(3))
def test_batch_equals_a_walk(spark, seed):
    rows = log(seed)
    got = {r.assignment_uuid: tuple(r)[1:] for r in capture.assignment_states(table(spark, [*rows, *rows[::3]])).collect()}
    assert got == plain(rows)


def run(spark, tmp_path, batches, settled="7 days"):
    """The stream over batches of events, a file and a restart for each."""
    source, store, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    for rows in batches:
        table(spark, rows).coalesce(1).write.mode("append").parquet(source)
        states.stored_states(spark.readStream.schema(capture.EVENTS).parquet(source), store, marks, settled).awaitTermination()
    return states.current_states(spark.read.parquet(store))


@pytest.mark.parametrize("seed", range(2))
def test_any_order_and_batching_gives_the_batch_table(spark, tmp_path, seed):
    rows = log(seed, days=1)
    rnd = random.Random(seed)
    mixed = [*rows, *rnd.sample(rows, len(rows) // 3)]  # some events arrive twice
    rnd.shuffle(mixed)
    cuts = sorted(rnd.sample(range(len(mixed)), 3))
    batches = [mixed[a:b] for a, b in zip([0, *cuts], [*cuts, len(mixed)])]
    got = run(spark, tmp_path, batches).collect()
    assert {r.assignment_uuid: tuple(r)[1:-1] for r in got} == plain(rows) and all(r.late == 0 for r in got)


def test_settled_events_are_let_go_and_late_ones_counted(spark, tmp_path):
    at = lambda h: NOW + timedelta(hours=h)
    event = lambda i, kind, h, category=None, intensity=None: (i, "a", kind, at(h), True, None, category, intensity, None)
    first = [event("1", "opened", 0), event("2", "submitted", 1, "Fear", 3), event("3", "activity", 50)]
    late = [event("2", "submitted", 1, "Fear", 3), event("0", "reset", 0.5), event("4", "submitted", 49, "Neutral", 0)]
    row = run(spark, tmp_path, [first, late], settled="1 day").first()
    # the repeated submission and the reset are behind settled events; the second submission is in time
    assert (row.status, row.started_at, row.completed_at, row.visible_category, row.late) == ("complete", at(0), at(49), "Neutral", 2)


def test_states_agree_with_the_operators_on_studies(spark):
    """Openings, submissions and activity as the study's own operators take them, each from all events at once."""
    rows = [r for r in log(9, assignments=15, kinds=("opened", "activity", "submitted")) if r[1] != "a3"]
    opened = {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        opened.setdefault(r[1], r[3])
    rows += [(f"o{a}", a, "opened", at - timedelta(seconds=1), True, None, None, None, None) for a, at in opened.items()]  # all are opened first
    events = table(spark, rows)
    work = [(f"a{i}", "t", "R1", "primary", i, "pending", None, None, None) for i in range(15)]
    study = S.empty_study(spark) | {"assignments": spark.createDataFrame(work, S.schema("assignments"))}
    study = exchange.opened(study, events.where("kind = 'opened'").select("assignment_uuid", F.col("at").alias("opened_at")))
    sent = events.where("kind = 'submitted'").select("assignment_uuid", "visible_category", "intensity", F.col("at").alias("submitted_at"), "duration_ms", "event_id")
    last = exchange.latest(sent.where("(visible_category = 'Fear' AND intensity = 3) OR (visible_category = 'Neutral' AND intensity = 0)"), ["assignment_uuid"], "submitted_at", "event_id").drop("event_id")
    study, _ = exchange.save_ratings(study, "frame_ratings", last)
    want = {r.assignment_uuid: (r.status, r.started_at, r.completed_at, r.duration_ms) for r in study["assignments"].collect() if r.assignment_uuid != "a3"}
    rated = {r.assignment_uuid: (r.visible_category, r.intensity) for r in study["frame_ratings"].collect()}
    active = {r.assignment_uuid: r.active_ms for r in progress.active_time(events, "assignment_uuid", F.unix_millis("at"), F.col("visible"), order=("event_id",)).collect()}
    got = capture.assignment_states(events).collect()
    assert {r.assignment_uuid: (r.status, r.started_at, r.completed_at, r.duration_ms) for r in got} == want
    assert {r.assignment_uuid: (r.visible_category, r.intensity) for r in got if r.status == "complete"} == rated
    assert {r.assignment_uuid: r.active_ms for r in got} == active
