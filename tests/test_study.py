"""Goldens and invariants of design, agreement, exchange and integrity."""

import uuid
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ratelens import schemas as S
from ratelens.functions import columns as C
from ratelens.operators import agreement, design, exchange, integrity, progress
from ratelens.sources import files

NOW = datetime(2026, 1, 1)
RISE = [float(x) for x in [0, 0, 1, 2, 3, 4, 5, 6, 5, 4, 3, 2, 1, 0, 0, 0]]


def one(df):
    return df.collect()[0][0]


def test_ids(spark):
    row = spark.range(1).select(C.stable_uuid("clip", "test", 1).alias("a"), C.stable_uuid("calibration", "clip", 1, F.lit(None)).alias("b"), C.bundle_id(F.lit("R01"), F.array(F.lit("b"), F.lit("a"))).alias("c")).first()
    assert row.a == "ebd7191d-0387-5441-b49d-3fdf3570914d"
    assert row.b == "98ad1348-0c5d-58ce-bdd4-44b8e64cd9e3"
    assert row.c == "77cf67aebbc083ccb6fa"
    names = spark.range(200).select("id", C.uuid5(F.concat(F.lit("é:"), F.col("id").cast("string"))).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.UUID(C.NAMESPACE), f"é:{r.id}")) for r in names)


@pytest.mark.parametrize("votes,entropy,margin,top", [([8, 2, 0, 0, 0, 0, 0], 0.2571559759740807, 6, 8), ([5, 5, 0, 0, 0, 0, 0], 0.3562071871080222, 0, 5), ([10, 0, 0, 0, 0, 0, 0], 0.0, 10, 10), ([0] * 7, 0.0, 0, 0)])
def test_clarity(spark, votes, entropy, margin, top):
    df = spark.createDataFrame([(*votes, 1)], ", ".join(f"`{c}` int" for c in files.VOTE_COLUMNS) + ", order int")
    row = design.label_clarity(df, files.VOTE_COLUMNS).first()
    assert row.vote_entropy == pytest.approx(entropy) and row.vote_margin == margin and row.vote_max == top
    assert design.vote_violations(df, files.VOTE_COLUMNS).count() == (sum(votes) != 10)


def test_quartiles_and_allocation(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 7)] + [(9, None)], "clip_id int, v double")
    bins = [r.b for r in df.select("clip_id", C.quartile_bin(F.col("v"), [F.col("clip_id")]).alias("b")).orderBy("clip_id").collect()]
    assert bins == [0, 0, 1, 2, 3, 3, None]
    sizes = spark.createDataFrame([("a", 7), ("b", 2), ("c", 1)], "k string, n int")
    got = design.largest_remainder(sizes, ["k"], F.lit(3), F.col("n") * 0.3).orderBy("k").collect()
    assert [r.allocated for r in got] == [2, 1, 0]
    assert design.stratified_sample(spark.range(5).withColumn("k", F.lit(1)), ["k"], 0.5, design.shuffled(1, "id")).count() == 2  # half-even


def test_rating_rules(spark):
    rows = [("Neutral", 0, None), ("Neutral", 1, "must_be_zero"), ("Face not visible", 1, "must_be_zero"), ("Unclear", 0, None), ("Unclear", 6, None), ("Mixed", 0, "must_be_positive"), ("Happiness", 1, None), ("Happiness", 7, "intensity"), ("Joy", 1, "category"), (None, 1, "category"), ("Fear", None, "intensity")]
    df = spark.createDataFrame(rows, "c string, i int, wanted string")
    assert df.where(~C.frame_rating_error(F.col("c"), F.col("i")).eqNullSafe(F.col("wanted"))).count() == 0
    zero = ["0"] * 16
    rows = [("Neutral", zero, None), ("Neutral", ["1"] + zero[1:], "must_be_zero"), ("Unclear", zero, None), ("Happiness", zero, "must_be_positive"), ("Happiness", ["1"] + zero[1:], None), ("Fear", zero[1:], "points"), ("Fear", ["7"] + zero[1:], "intensity"), ("Fear", ["x"] + zero[1:], "intensity"), ("Fear", None, "points")]
    df = spark.createDataFrame(rows, "c string, p array<string>, wanted string")
    assert df.where(~C.clip_rating_error(F.col("c"), F.col("p")).eqNullSafe(F.col("wanted"))).count() == 0
    clamp = spark.createDataFrame([(-5,), (90_000_000,), (None,)], "d long").select(C.duration(F.col("d")).alias("d")).collect()
    assert [r.d for r in clamp] == [0, 86_400_000, None]


@pytest.fixture(scope="module")
def study(spark):
    test = spark.createDataFrame([(i + 1, i % 7 + 1) for i in range(21)], "clip_id int, label int")
    train = spark.createDataFrame([(i + 101, i % 7 + 1) for i in range(14)], "clip_id int, label int")
    tasks, work = design.prepare_study(test, train, ["R01", "R02"])
    return tasks.cache(), work.cache()


def test_design_counts_and_gap(spark, study):
    tasks, work = study
    assert (tasks.count(), work.count()) == (412, 447)
    assert tasks.select("task_uuid").distinct().count() == 412 and work.select("assignment_uuid").distinct().count() == 447
    kinds = {(r.task_type, r.repeat_kind): r["count"] for r in tasks.groupBy("task_type", "repeat_kind").count().collect()}
    assert kinds == {("frame", "none"): 336, ("frame", "second_rater"): 34, ("frame", "within_rater"): 7, ("clip", "none"): 35}
    queue = defaultdict(list)
    for r in work.join(tasks.select("task_uuid", "task_type", F.col("clip_id").alias("clip")), "task_uuid").orderBy("queue_position").collect():
        queue[r.annotator_code].append(r)
    for own in queue.values():
        assert [r.queue_position for r in own] == list(range(1, len(own) + 1))
        clips = [r.clip for r in own if r.task_type == "frame"]
        assert all(clips[i] not in clips[max(0, i - 9) : i] for i in range(len(clips)))
    rows = {r.task_uuid: r for r in work.collect() if r.role == "primary"}
    for r in tasks.join(work.select("task_uuid", "annotator_code", "role"), "task_uuid").where("source_task_uuid IS NOT NULL").collect():
        assert (rows[r.source_task_uuid].annotator_code == r.annotator_code) == (r.repeat_kind == "within_rater")


RATINGS = "task_uuid string, annotator_code string, role string, category string, curve array<double>"
ZEROS, LEFT, RIGHT = [0.0] * 16, [5.0, 5.0] + [0.0] * 14, [0.0] * 14 + [5.0, 5.0]


@pytest.mark.parametrize("a,b,reasons", [
    ((RISE, "Happiness"), (RISE, "Happiness"), []), ((RISE, "Happiness"), (RISE, "Sadness"), ["category"]),
    ((RISE, "Happiness"), (ZEROS, "Neutral"), ["category", "intensity_gap", "peak_type"]), ((LEFT, "Anger"), (RIGHT, "Anger"), ["intensity_gap", "peak_gap", "peak_type"]),
    ((RISE, "Happiness"), ([1.0] * 15, "Sadness"), ["category", "invalid_curve"]),
])
def test_disagreement(spark, a, b, reasons):
    df = spark.createDataFrame([("t", "R1", "primary", a[1], a[0]), ("t", "R2", "second", b[1], b[0]), ("u", "R1", "primary", "Fear", RISE)], RATINGS)
    got = agreement.disagreements(df).collect()
    assert [(r.task_uuid, r.needed, r.reasons) for r in got] == [("t", bool(reasons), reasons)]


def test_consensus(spark):
    high = [x + 0.5 if x else 0.0 for x in RISE]
    rows = [("alone", "R1", "primary", "Fear", RISE), ("agree", "R1", "primary", "Fear", RISE), ("agree", "R2", "second", "Fear", high), ("open", "R1", "primary", "Fear", RISE), ("open", "R2", "second", "Anger", RISE)]
    for name, third in (("two", "Fear"), ("none", "Sadness")):
        rows += [(name, "R1", "primary", "Fear", RISE), (name, "R2", "second", "Anger", RISE), (name, "R3", "adjudication", third, ZEROS)]
    rows += [("cal", f"R{i}", "primary", "Fear", RISE) for i in (1, 2, 3)]
    got = {r.task_uuid: r for r in agreement.consensus(spark.createDataFrame(rows, RATINGS)).collect()}
    assert sorted(got) == ["agree", "cal", "none", "two"]
    assert got["agree"].n_ratings == 2 and got["agree"].curve[7] == 6.25 and got["agree"].category == "Fear"
    assert got["two"].category == "Fear" and got["two"].curve == RISE and got["two"].needed
    assert got["none"].category == "No consensus" and got["none"].apex_position is None
    assert got["cal"].n_ratings == 3 and not got["cal"].needed
    records = agreement.adjudication_records(agreement.consensus(spark.createDataFrame(rows, RATINGS))).collect()
    assert {(r.task_uuid, r.reasons, r.final_category) for r in records} == {("two", "category", "Fear"), ("none", "category", "No consensus")}


def test_new_adjudications(spark):
    rows = [("t", "R1", "primary", "Fear", RISE), ("t", "R2", "second", "Anger", RISE)]
    tasks = spark.createDataFrame([("t", "clip", "test")], "task_uuid string, task_type string, split string")
    work = spark.createDataFrame([("t", "R1", "primary", 5), ("x", "R3", "primary", 8)], "task_uuid string, annotator_code string, role string, queue_position int")
    people = spark.createDataFrame([("R1", 1), ("R2", 1), ("R3", 1)], "code string, active int")
    got = agreement.new_adjudications(spark.createDataFrame(rows, RATINGS), tasks, people, work).first()
    assert (got.annotator_code, got.queue_position, got.problem) == ("R3", 9, None)
    got = agreement.new_adjudications(spark.createDataFrame(rows, RATINGS), tasks, people.where("code <> 'R3'"), work).first()
    assert got.annotator_code is None and got.problem


@pytest.fixture
def small(spark):
    t = S.empty_study(spark)
    make = lambda name, rows: spark.createDataFrame(rows, S.schema(name))
    return t | {
        "annotators": make("annotators", [("R1", "R1", 1, NOW), ("R2", "R2", 1, NOW)]),
        "study_meta": make("study_meta", [("design_version", "1")]),
        "tasks": make("tasks", [("f", "frame", "test", 1, 3, None, "none", NOW), ("c", "clip", "test", 1, None, None, "none", NOW)]),
        "assignments": make("assignments", [("a1", "f", "R1", "primary", 1, "pending", None, None, None), ("a2", "c", "R1", "primary", 2, "pending", None, None, None), ("b2", "c", "R2", "second", 1, "pending", None, None, None)]),
    }


def rated(spark, study, value=3):
    rows = spark.createDataFrame([("a1", "Fear", value, NOW, 90_000_000), ("zz", "Fear", 3, NOW, 5)], "assignment_uuid string, visible_category string, intensity int, submitted_at timestamp, duration_ms long")
    return exchange.save_ratings(study, "frame_ratings", rows)


def test_ratings_export_and_merge(spark, small):
    assert integrity.constraint_violations(small).count() == 0
    done, rejected = rated(spark, small)
    assert [(r.assignment_uuid, r.error) for r in rejected.collect()] == [("zz", "assignment")]
    row = done["assignments"].where("assignment_uuid = 'a1'").first()
    assert (row.status, row.duration_ms) == ("complete", 86_400_000)
    out = exchange.export_results(exchange.rater_bundle(done, "R1"), "R1")
    about = out["bundle"].first()
    assert about.completed_assignments == 1 and out["frame_ratings"].count() == 1
    key = out["bundle"].select("bundle_id")
    sent = {k: (v if "bundle_id" in v.columns else v.crossJoin(key)) for k, v in out.items()} | {"bundle": out["bundle"].withColumn("source_path", F.lit("x"))}
    once = exchange.merged(small, sent)
    assert once["frame_ratings"].count() == 1 and once["import_log"].first().rows_imported == 1
    twice = exchange.merged({k: spark.createDataFrame(v.collect(), v.schema) for k, v in once.items()}, sent)
    assert sorted(map(str, twice["assignments"].collect())) == sorted(map(str, once["assignments"].collect())) and twice["import_log"].count() == 1
    with pytest.raises(ValueError):
        exchange.merged(small | {"assignments": small["assignments"].where("assignment_uuid <> 'a1'")}, sent)
    reset = exchange.reset_practice(done, "R1")
    assert reset["frame_ratings"].count() == 0 and reset["assignments"].where("status <> 'pending'").count() == 0


def test_violations(spark, small):
    broken = small | {"assignments": small["assignments"].withColumn("task_uuid", F.lit("gone")).withColumn("role", F.lit("boss"))}
    checks = {r.check for r in integrity.constraint_violations(broken).collect()}
    assert {"assignments.task_uuid", "assignments.role"} <= checks
    checks = {r.check: r.detail for r in integrity.study_violations(small, 1, 9, require_complete=True).collect()}
    assert checks == {"base_frame_tasks": "1", "incomplete": "3"}


def test_progress_of_an_empty_study(spark):
    empty = spark.createDataFrame([], "annotator_code string, task_type string, split string, status string, duration_ms long, queue_position int, assignment_uuid string")
    assert progress.workload(empty).count() == 0 and progress.next_task(empty).count() == 0


def test_calibration(spark, small):
    people = spark.createDataFrame([("R1", 1), ("R2", 1), ("R3", 1)], "code string, active int")
    manifest = spark.createDataFrame([(7, "frame", 2, 1), (7, "clip", None, 2)], "clip_id int, task_type string, frame_index int, position int")
    tasks, work = design.prepare_calibration(manifest, people, small["tasks"], small["assignments"])
    assert tasks.count() == 4 and work.count() == 9
    assert work.where("assignment_uuid = 'a1'").first().queue_position == 3
    clips, votes = design.demo_study(spark)
    assert clips.count() == 21 and design.vote_violations(votes, files.VOTE_COLUMNS).count() == 0
    rows = [("t", c, "Fear", [float(v)]) for c, v in (("R1", 1), ("R2", 3), ("R3", 6))]
    got = agreement.calibration_report(spark.createDataFrame(rows, "task_uuid string, annotator_code string, category string, curve array<double>")).first()
    assert (got.category_unanimous, got.categories) == (1, "Fear|Fear|Fear") and got.mean_pairwise_intensity_gap == pytest.approx(10 / 3)


def test_files(spark, tmp_path, small):
    path = tmp_path / "split.csv"
    path.write_text("video_name,label\n3,5\n3,2\n4,9\n5,7\n5,1\n")
    rows = files.csv(spark, str(path), "video_name int, label int", ("video_name", "label"), line="line")
    assert {(r.clip_id, r.label, r.emotion) for r in files.load_split(rows).collect()} == {(3, 5, "Surprise"), (5, 7, "Fear")}
    with pytest.raises(ValueError):
        files.csv(spark, str(path), "video_name int", ("gone",))
    files.snapshot(small, str(tmp_path / "copy"))
    assert files.restored(spark, str(tmp_path / "copy"), ["tasks"])["tasks"].count() == 2
    with pytest.raises(Exception):
        files.snapshot(small, str(tmp_path / "copy"))
    files.write_csv(spark.createDataFrame([(1, [1.0], None)], "a int, b array<double>, c double"), str(tmp_path / "out"), ["b", "a", "c"], nan_text="nan")
    assert (tmp_path / "out").read_text() == "b,a,c\n[1.0],1,nan\n"


def test_stimulus_audit_counts_in_all_partitions(spark):
    """Small keys were merged by their bytes into few partitions, so a task's memory grew with the table."""
    clips = spark.range(3000).select((F.col("id") % 2000).cast("int").alias("clip_id")).unionAll(spark.sql("SELECT CAST(NULL AS INT)"))
    stimulus = spark.range(1000, 4000).select("id").unionAll(spark.range(2500, 2600)).unionAll(spark.sql("SELECT CAST(NULL AS BIGINT) FROM range(2)")).toDF("clip_id")
    out = files.stimulus_audit(stimulus, clips)
    want = [("missing", i) for i in [*range(1000), None]] + [("duplicate", i) for i in [*range(2500, 2600), None]]
    key = lambda r: (r[0], r[1] is None, r[1] or 0)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert out.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
