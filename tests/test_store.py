"""Versions of a study under several writers."""

import threading

import pytest
from pyspark.sql import functions as F

from ratelens import schemas as S
from ratelens import store
from ratelens.operators import exchange


@pytest.fixture
def folder(spark, tmp_path):
    make = lambda name, rows: spark.createDataFrame(rows, S.schema(name))
    from datetime import datetime

    now = datetime(2026, 1, 1)
    study = S.empty_study(spark) | {
        "study_meta": make("study_meta", [("design_version", "1")]), "annotators": make("annotators", [(f"R{i}", "", 1, now) for i in (1, 2)]),
        "tasks": make("tasks", [(f"t{i}", "frame", "test", i, 1, None, "none", now) for i in range(4)]),
        "assignments": make("assignments", [(f"a{i}", f"t{i}", f"R{i % 2 + 1}", "primary", i, "pending", None, None, None) for i in range(4)]),
    }
    store.save(study, str(tmp_path / "study"))
    return str(tmp_path / "study")


def bundle(spark, name, ids, rating="Fear", intensity=3):
    work = spark.createDataFrame([(i, f"t{i[1:]}", f"R{int(i[1:]) % 2 + 1}", 7, name) for i in ids], "assignment_uuid string, task_uuid string, annotator_code string, duration_ms long, bundle_id string")
    work = work.withColumns({c: F.lit(None).cast("timestamp") for c in ("started_at", "completed_at")})
    ratings = spark.createDataFrame([(i, rating, intensity, name) for i in ids], "assignment_uuid string, visible_category string, intensity int, bundle_id string").withColumn("submitted_at", F.lit(None).cast("timestamp"))
    clips = spark.createDataFrame([], S.schema("clip_ratings")).withColumn("bundle_id", F.lit(name))
    about = spark.createDataFrame([(name, "1", "x", 0)], "bundle_id string, design_version string, source_path string, number int")
    return {"bundle": about, "assignments": work, "frame_ratings": ratings, "clip_ratings": clips}


def test_two_interleaved_merges_lose_nothing(spark, folder):
    tries = []

    def slow(study):
        tries.append(len(tries))
        if len(tries) == 1:  # another writer commits between this one's reading and claiming
            assert store.update(spark, folder, lambda s: exchange.merged(s, bundle(spark, "B2", ["a1", "a3"])), "merge") == 2
        return exchange.merged(study, bundle(spark, "B1", ["a0", "a2"]))

    assert store.update(spark, folder, slow, "merge") == 3 and tries == [0, 1]
    done = store.load(spark, folder)
    assert {r.assignment_uuid for r in done["frame_ratings"].collect()} == {"a0", "a1", "a2", "a3"}
    assert done["assignments"].where("status = 'complete'").count() == 4
    assert {r.bundle_id for r in done["import_log"].collect()} == {"B1", "B2"}
    assert [(r.version, r.parent, r.operation) for r in store.history(spark, folder).collect()] == [(1, None, "save"), (2, 1, "merge"), (3, 2, "merge")]
    assert store.swept(spark, folder, older_than=0) == []  # what the first try wrote is gone already


def test_one_bundle_merged_twice_at_once_counts_once(spark, folder):
    def slow(study, first=[True]):  # noqa: B006
        if first.pop() if first else False:
            store.update(spark, folder, lambda s: exchange.merged(s, bundle(spark, "B1", ["a0"])), "merge")
        return exchange.merged(study, bundle(spark, "B1", ["a0"]))

    store.update(spark, folder, slow, "merge")
    assert store.load(spark, folder)["import_log"].count() == 1


def test_a_version_is_claimed_once(spark, folder):
    study = store.load(spark, folder)
    assert store.save(study, folder, base=1) == 2
    with pytest.raises(store.Conflict):
        store.save(study, folder, base=1)
    assert store.versions(folder) == [1, 2]


def test_unchanged_tables_are_not_written_again(spark, folder):
    store.update(spark, folder, lambda s: s | {"drafts": spark.createDataFrame([("a0", "{}", None)], "assignment_uuid string, payload_json string, at string").withColumn("updated_at", F.current_timestamp())})
    first, second = store.entry(spark, folder, 1)["tables"], store.entry(spark, folder, 2)["tables"]
    assert [t for t in S.TABLES if first[t] != second[t]] == ["drafts"]
    assert store.load(spark, folder, 1)["drafts"].count() == 0 and store.load(spark, folder)["drafts"].count() == 1


@pytest.mark.parametrize("odd", [{"rating": "Joy"}, {"intensity": 9}, {"intensity": None}])
def test_a_refused_merge_leaves_nothing(spark, folder, odd):
    with pytest.raises(ValueError, match="refuses"):
        store.update(spark, folder, lambda s: exchange.merged(s, bundle(spark, "B1", ["a0"], **odd)), "merge")
    assert store.versions(folder) == [1] and store.load(spark, folder)["frame_ratings"].count() == 0
    assert store.swept(spark, folder, older_than=0) == []


def test_ratings_of_unknown_assignments_are_refused(spark, folder):
    sent = bundle(spark, "B1", ["a0"])
    sent["frame_ratings"] = bundle(spark, "B1", ["a0", "a9"])["frame_ratings"]
    with pytest.raises(ValueError, match="a9"):
        exchange.merged(store.load(spark, folder), sent)


def test_a_write_that_breaks_off_leaves_nothing(spark, folder):
    broken = F.raise_error(F.lit("disk full")).cast("string")
    with pytest.raises(Exception, match="disk full"):
        store.update(spark, folder, lambda s: s | {"tasks": s["tasks"].withColumn("split", broken)})
    assert store.versions(folder) == [1] and store.swept(spark, folder, older_than=0) == []


def test_left_tables_are_swept(spark, folder):
    spark.range(3).write.parquet(f"{folder}/{store.DATA}/000002-killed")
    assert store.swept(spark, folder) == [] and store.swept(spark, folder, older_than=0) == ["000002-killed"]
    assert store.load(spark, folder)["tasks"].count() == 4


def test_many_writers(spark, folder):
    def add(i):
        row = spark.createDataFrame([(f"k{i}", str(i))], "key string, value string")
        store.update(spark, folder, lambda s: s | {"study_meta": s["study_meta"].unionByName(row)}, f"add {i}", attempts=50)

    threads = [threading.Thread(target=add, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.versions(folder) == list(range(1, 8))
    assert {r.key for r in store.load(spark, folder)["study_meta"].collect()} == {"design_version", *(f"k{i}" for i in range(6))}


def test_nothing_there(spark, tmp_path):
    assert store.versions(str(tmp_path / "none")) == []
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "none"))
