"""A demo study from its making to its consensus, by commands."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from ratelens import store
from ratelens.__main__ import main
from ratelens.operators import exchange
from ratelens.sources import files


def test_a_whole_study(spark, tmp_path):
    run = lambda *a: main([str(x) for x in a], spark)
    demo, folder, own = tmp_path / "demo", tmp_path / "study", tmp_path / "own"
    run("make-demo", "--output", demo)
    run("prepare-study", "--study", folder, "--test", demo / "test.csv", "--train", demo / "train.csv", "--votes", demo / "votes.csv", "--frames", demo / "frames", "--raters", "R1", "R2", "--gap", 3)
    study = store.load(spark, folder)
    assert study["tasks"].where("repeat_kind = 'none' AND task_type = 'frame'").count() == 7 * 16
    run("prepare-practice", "--study", tmp_path / "practice", "--frames", demo / "frames")
    run("make-annotator-bundle", "--study", folder, "--rater", "R1", "--output", own, "--practice", tmp_path / "practice", "--config", demo / "project.toml")
    assert store.load(spark, f"{own}/practice")["tasks"].count() == 21 and files.load_config(own / "project.toml")["paths"] == {"frames": "frames"}
    with pytest.raises(ValueError, match="R7"):
        run("make-annotator-bundle", "--study", folder, "--rater", "R7", "--output", tmp_path / "none")
    mine = store.load(spark, own)
    assert mine["assignments"].select("annotator_code").distinct().collect()[0][0] == "R1"
    work = mine["assignments"].join(mine["tasks"].select("task_uuid", "task_type"), "task_uuid")
    now = F.current_timestamp().alias("submitted_at")
    clips = work.where("task_type = 'clip'").select("assignment_uuid", F.lit("Fear").alias("dominant_category"), F.array_repeat(F.lit(3.0), 16).alias("intensities"), *[F.lit(0).alias(c) for c in ("occlusion", "speaking", "abrupt_change", "subject_switch")], now, F.lit(1000).alias("duration_ms"))
    done, rejected = exchange.save_ratings(mine, "clip_ratings", clips)
    assert rejected.count() == 0
    store.save(done, own)
    run("export", "--study", own, "--rater", "R1", "--output", tmp_path / "sent")
    run("merge", "--study", folder, "--folders", tmp_path / "sent")
    merged = store.load(spark, folder)
    assert merged["clip_ratings"].count() == 21 and merged["import_log"].first().rows_imported == 21
    assert merged["clip_ratings"].first().intensities == [3.0] * 16
    run("status", "--study", folder)
    run("validate-study", "--study", folder)
    run("export-consensus", "--study", folder, "--output", tmp_path / "agreed")
    assert len((tmp_path / "agreed" / "trajectory_consensus.csv").read_text().splitlines()) == 1
    raw = gzip.decompress((tmp_path / "agreed" / "clip_ratings.csv.gz").read_bytes()).decode().splitlines()
    assert raw[0].split(",")[:12] == ["annotator_code", "role", "duration_ms", "clip_id", "split", "dominant_category", "intensities_json", "occlusion", "speaking", "abrupt_change", "subject_switch", "submitted_at"]
    assert len(raw) == 22 and raw[1].endswith(",3" * 16) and '"[' + "3, " * 15 + '3]"' in raw[1]
    assert store.versions(folder) == [1, 2] and [r.operation for r in store.history(spark, folder).collect()] == ["prepare-study", "merge"]
    broken = merged["clip_ratings"].withColumn("intensities", F.slice("intensities", 1, 15))
    store.save(merged | {"clip_ratings": broken}, folder)
    with pytest.raises(SystemExit):
        run("validate-study", "--study", folder)


def test_calibration_keeps_the_manifest_in_order(spark, tmp_path):
    run = lambda *a: main([str(x) for x in a], spark)
    demo, folder = tmp_path / "demo", tmp_path / "study"
    run("make-demo", "--output", demo)
    run("prepare-study", "--study", folder, "--config", demo / "project.toml")
    study = store.load(spark, folder)
    third = spark.createDataFrame([("R03", "third", 1)], "code string, display_name string, active int").withColumn("created_at", F.current_timestamp())
    store.save(study | {"annotators": study["annotators"].unionByName(third)}, folder)
    manifest = tmp_path / "manifest.csv"
    manifest.write_text("clip_id,task_type,frame_index\n9,frame,6\n5,clip,\n3,frame,2\n9,clip,\n")
    run("prepare-calibration", "--study", folder, "--manifest", manifest)
    done = store.load(spark, folder)
    queue = done["assignments"].join(done["tasks"].where("split = 'calibration'"), "task_uuid").where("annotator_code = 'R01'").orderBy("queue_position").collect()
    assert [(r.queue_position, r.clip_id, r.task_type, r.frame_index) for r in queue] == [(1, 9, "frame", 6), (2, 5, "clip", None), (3, 3, "frame", 2), (4, 9, "clip", None)]
    assert {r.key: r.value for r in done["study_meta"].collect()}["calibration_tasks"] == "4"
    assert done["assignments"].where("annotator_code = 'R01'").agg(F.min("queue_position"), F.max("queue_position"), F.count("*")).first()[:] == (1, 87, 87)  # half of 125 frames and of 42 clips, and four
    work = done["assignments"].join(done["tasks"].where("split = 'calibration'").select("task_uuid", "task_type"), "task_uuid")
    rated = work.where("task_type = 'frame'").select("assignment_uuid", F.lit("Fear").alias("visible_category"), F.substring("annotator_code", 3, 1).cast("int").alias("intensity"), F.current_timestamp().alias("submitted_at"))
    store.save(done | {"frame_ratings": rated}, folder)
    run("calibration-report", "--study", folder, "--output", tmp_path / "report.csv")
    lines = (tmp_path / "report.csv").read_text().splitlines()
    assert lines[0] == "task_type,clip_id,frame,n_completed,category_unanimous,categories,mean_pairwise_intensity_gap"
    assert [x.split(",")[:6] for x in lines[1:]] == [["frame", "3", "2", "3", "1", "Fear|Fear|Fear"], ["frame", "9", "6", "3", "1", "Fear|Fear|Fear"]]
    with pytest.raises(ValueError, match="already"):
        run("prepare-calibration", "--study", folder, "--manifest", manifest)


def test_select_calibration_writes_a_manifest_in_order(spark, tmp_path):
    run = lambda *a: main([str(x) for x in a], spark)
    demo, folder = tmp_path / "demo", tmp_path / "study"
    run("make-demo", "--output", demo)
    run("prepare-study", "--study", folder, "--config", demo / "project.toml")
    run("select-calibration", "--study", folder, "--votes", demo / "votes.csv", "--frames", demo / "frames", "--clips", 2, "--output", tmp_path / "cal")
    lines = (tmp_path / "cal" / "manifest.csv").read_text().splitlines()
    assert lines[0] == "clip_id,task_type,frame_index" and [x.split(",")[1] for x in lines[1:]] == ["frame"] * 14 + ["clip"] * 14
    key = [x.split(",") for x in (tmp_path / "cal" / "key.csv").read_text().splitlines()]
    assert [r[key[0].index("clip_id")] for r in key[1:]] == [x.split(",")[0] for x in lines[1:15]] == [x.split(",")[0] for x in lines[15:]]
    run("select-calibration", "--study", tmp_path / "later", "--config", demo / "project.toml", "--clips", 2, "--output", tmp_path / "before")
    assert (tmp_path / "before" / "manifest.csv").read_text() == (tmp_path / "cal" / "manifest.csv").read_text()


def test_practice(spark, tmp_path):
    run = lambda *a: main([str(x) for x in a], spark)
    demo, folder, formal = tmp_path / "demo", tmp_path / "practice", tmp_path / "formal"
    run("make-demo", "--output", demo)
    run("prepare-practice", "--study", folder, "--frames", demo / "frames")
    study = store.load(spark, folder)
    assert {r.key: r.value for r in study["study_meta"].collect()} == {"design_version": "practice-1", "practice_mode": "1", "formal_clip_overlap": "0", "practice_frame_tasks": "14", "practice_clip_tasks": "7"}
    work = study["assignments"].join(study["tasks"].drop("created_at"), "task_uuid").orderBy("queue_position").collect()
    assert [(r.queue_position, r.task_type, r.frame_index, r.annotator_code, r.split) for r in work] == [(i + 1, "frame" if i < 14 else "clip", i * 5 % 16 + 1 if i < 14 else None, "TEST", "calibration") for i in range(21)]
    assert len({r.clip_id for r in work}) == 21
    run("prepare-practice", "--study", folder, "--frames", demo / "frames")
    assert store.versions(folder) == [1]
    store.save(study | {"assignments": study["assignments"].withColumn("status", F.lit("complete"))}, folder)
    run("annotator-check", "--study", folder, "--frames", demo / "frames")
    with pytest.raises(ValueError, match="practice"):
        run("export-package", "--study", folder, "--rater", "TEST", "--output", tmp_path / "out")
    run("reset-practice", "--study", folder, "--rater", "TEST")
    assert store.load(spark, folder)["assignments"].where("status <> 'pending'").count() == 0
    run("prepare-study", "--study", formal, "--config", demo / "project.toml")
    with pytest.raises(ValueError, match="21"):
        run("prepare-practice", "--study", tmp_path / "other", "--frames", demo / "frames", "--formal", formal)
    with pytest.raises(ValueError, match="reset"):
        run("reset-practice", "--study", formal, "--rater", "R01")
    (demo / "frames" / "00003" / "16.jpg").unlink()
    with pytest.raises(ValueError, match="3"):
        run("annotator-check", "--study", folder, "--frames", demo / "frames")


def test_prepare_study_with_a_workbook_and_an_archive(spark, tmp_path):
    from test_sinks import book

    run = lambda *a: main([str(x) for x in a], spark)
    demo = tmp_path / "demo"
    run("make-demo", "--output", demo)
    rows = [x.split(",") for x in (demo / "votes.csv").read_text().splitlines()]
    head = '<row r="1">' + "".join(f'<c r="{chr(65 + i)}1" t="s"><v>{i}</v></c>' for i in range(9)) + "</row>"
    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}"><v>{v}</v></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows[1:], 2))
    book(demo / "votes.xlsx", {"sheet": head + body}, [f"<t>{n}</t>" for n in ["a", "b", "c", "d", "e", "f", "g", *rows[0][7:]]])
    with zipfile.ZipFile(demo / "frames.zip", "w") as archive:
        for path in sorted((demo / "frames").rglob("*.jpg")):
            archive.write(path, f"any/{path.parent.name}/{path.name}")
    options = ["--test", demo / "test.csv", "--train", demo / "train.csv", "--raters", "R01", "R02", "--gap", 2]
    run("prepare-study", "--study", tmp_path / "one", "--votes", demo / "votes.xlsx", "--frames", demo / "frames.zip", *options)
    run("prepare-study", "--study", tmp_path / "two", "--votes", demo / "votes.csv", "--frames", demo / "frames", *options)
    one, two = ({(r.assignment_uuid, r.queue_position) for r in store.load(spark, tmp_path / n)["assignments"].collect()} for n in ("one", "two"))
    assert one == two and len(one) == 167
    with zipfile.ZipFile(demo / "short.zip", "w") as archive:
        for path in sorted((demo / "frames").rglob("*.jpg")):
            if path.name != "7.jpg" or path.parent.name != "00020":
                archive.write(path, f"{path.parent.name}/{path.name}")
    with pytest.raises(ValueError, match="20"):
        run("prepare-study", "--study", tmp_path / "three", "--votes", demo / "votes.csv", "--frames", demo / "short.zip", *options)
