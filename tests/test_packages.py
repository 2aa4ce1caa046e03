"""A study from a configuration, its gated result package, and what files are checked for."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ratelens import store
from ratelens.__main__ import _RATING_CSV, main
from ratelens.operators import design, progress
from ratelens.sources import files


def test_a_configured_study_and_its_package(spark, tmp_path):
    run = lambda *a: main([str(x) for x in a], spark)
    demo, folder, out = tmp_path / "demo", tmp_path / "study", tmp_path / "package"
    run("make-demo", "--output", demo)
    config = demo / "project.toml"
    config.write_text(config.read_text().replace("[study]", 'duplicate_candidates = "none.csv"\n[study]'))
    run("prepare-study", "--study", folder, "--config", config, "--selection", tmp_path / "selected.csv")
    study = store.load(spark, folder)
    assert study["tasks"].where("split = 'train_alignment'").count() == 14 and len((tmp_path / "selected.csv").read_text().splitlines()) == 15
    with pytest.raises(ValueError, match="already"):
        run("prepare-study", "--study", folder, "--config", config)
    run("init-db", "--study", folder)
    assert store.versions(folder) == [1]
    package = ("export-package", "--study", folder, "--rater", "R01", "--output", out)
    with pytest.raises(ValueError, match="not completed"):
        run(*package)
    store.save(study | {"assignments": study["assignments"].withColumn("status", F.lit("complete"))}, folder)
    run(*package)
    table, about = (out / "assignments.csv").read_bytes(), json.loads((out / "manifest.json").read_text())
    assert table.startswith(b"\xef\xbb\xbfassignment_uuid,task_uuid,annotator_code,") and about["files"]["assignments.csv"] == hashlib.sha256(table).hexdigest()
    assert (out / "clip_ratings.csv").read_text(encoding="utf-8-sig").startswith("assignment_uuid,dominant_category,intensities_json,")
    lines = table.decode("utf-8-sig").splitlines()
    assert len(lines) - 1 == about["completed_assignments"] == about["total_assignments"] and set(about["files"]) == {"assignments.csv", "tasks.csv", "frame_ratings.csv", "clip_ratings.csv"}
    places = [int(x.split(",")[4]) for x in lines[1:]]
    assert places == list(range(1, len(places) + 1))
    with zipfile.ZipFile(tmp_path / "package.zip") as archive:
        assert archive.read("assignments.csv") == table and set(archive.namelist()) == {*about["files"], "manifest.json"}
    sent = files.bundle_folders(spark, [out], _RATING_CSV)  # a package is a bundle
    assert sent["assignments"].count() == len(places) and "intensities" in sent["clip_ratings"].columns
    with pytest.raises(ValueError):
        run("prepare-study", "--study", tmp_path / "other", "--test", demo / "test.csv")


def test_release_check_and_votes(spark, tmp_path):
    (tmp_path / "b.zip").write_bytes(b"x")
    with pytest.raises(ValueError, match="b.zip"):
        main(["release-check", "--folder", str(tmp_path)], spark)
    votes = spark.createDataFrame([(1, 2, 3, 4, 0, 0, 0, 9)], "a int, b int, c int, d int, e int, f int, g int, `order` int")
    assert files.votes_by_position(votes).columns == [*files.VOTE_COLUMNS, "order"]
    with pytest.raises(ValueError):
        files.votes_by_position(votes.select("a"))
    assert files.exists(spark, tmp_path / "b.zip") and not files.exists(spark, tmp_path / "gone")


def test_bundles_need_a_description(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.bundle_folders(spark, [str(tmp_path)], {})


def test_places_equal_one_window(spark):
    rows = [(g, None if i % 9 == 0 else float(i * 7 % 5 if g == "a" else i * 31 % 97), i) for g in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, v double, i int").repartition(5)
    got = {(r.g, r.i): (r._place, r._known) for r in design.placed(df, ["g"], "v", ["i"]).collect()}
    for g in ("a", "b", None):
        own = sorted((v, i) for h, v, i in rows if h == g and v is not None)
        assert all(got[g, i] == (n, len(own)) for n, (_, i) in enumerate(own, 1))
        assert all(got[h, i][0] is None for h, v, i in rows if h == g and v is None)
    assert design.placed(df.limit(0), ["g"], "v", ["i"]).count() == 0
    work = spark.createDataFrame([(f"R{i % 2}", "frame", "test", "complete", 1000 * i) for i in range(1, 8)] + [("R9", "frame", "test", "started", None)], "annotator_code string, task_type string, split string, status string, duration_ms long")
    assert {r.annotator_code: r.median_completed_seconds for r in progress.workload(work).collect()} == {"R0": 4.0, "R1": 4.0, "R9": 4.0}
