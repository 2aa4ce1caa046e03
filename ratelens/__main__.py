"""Commands over a study folder: python -m ratelens COMMAND --study FOLDER ..."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from . import store
from .operators import agreement, design, exchange, integrity, progress
from .session import session
from .sources import files, frames

_RATING_CSV = {
    "assignments": "assignment_uuid string, task_uuid string, annotator_code string, role string, queue_position int, status string, started_at timestamp, completed_at timestamp, duration_ms bigint",
    "frame_ratings": "assignment_uuid string, visible_category string, intensity int, submitted_at timestamp",
    "clip_ratings": "assignment_uuid string, dominant_category string, intensities_json string, occlusion int, speaking int, abrupt_change int, subject_switch int, submitted_at timestamp",
}


def _rated(study: store.Study, frames_too: bool = False) -> DataFrame:
    work = study["assignments"].join(study["tasks"].select("task_uuid", "task_type", "split", "clip_id", "frame_index"), "task_uuid")
    clips = work.join(study["clip_ratings"], "assignment_uuid").select("task_uuid", "task_type", "split", "clip_id", "frame_index", "annotator_code", "role", F.col("dominant_category").alias("category"), F.col("intensities").alias("curve"))
    if not frames_too:
        return clips
    own = work.join(study["frame_ratings"], "assignment_uuid").select("task_uuid", "task_type", "split", "clip_id", "frame_index", "annotator_code", "role", F.col("visible_category").alias("category"), F.array(F.col("intensity").cast("double")).alias("curve"))
    return clips.unionByName(own)


def _assigned(study: store.Study) -> DataFrame:
    return progress.with_tasks(study["assignments"], study["tasks"], "task_type", "split", "clip_id", "frame_index")


def _whole_clips(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return frames.complete_clips(frames.frame_index(spark, a.frames, getattr(a, "password", None)))


def _split(spark: SparkSession, path: str) -> DataFrame:
    return files.load_split(files.csv(spark, path, "video_name int, label int", ("video_name", "label"), line="line"))


#: Where a configuration holds what commands take: option, section and name.
_SETTINGS = [("test", "paths", "test_csv"), ("train", "paths", "train_csv"), ("votes", "paths", "annotation_xlsx"), ("stimulus", "paths", "stimulus_features"), ("duplicates", "paths", "duplicate_candidates"), ("frames", "paths", "frames_16_archive"), ("frames", "paths", "frames"), ("password", "paths", "frames_archive_password"), ("raters", "study", "annotators"), ("second", "study", "frame_second_rating_fraction"), ("hidden", "study", "frame_hidden_repeat_fraction"), ("gap", "study", "frame_minimum_clip_gap"), ("per_class", "study", "training_per_non_disgust_class")]
_DEFAULTS = {"second": 0.10, "hidden": 0.02, "gap": 9, "per_class": 380}


def _configured(a: argparse.Namespace, needed: tuple[str, ...] = ("test", "train", "votes", "frames")) -> argparse.Namespace:
    """Options as given, else from the configuration, else by default; those that are needed must come from somewhere."""
    config = files.load_config(a.config) if a.config else {}
    for name, section, key in _SETTINGS:
        value = config.get(section, {}).get(key)
        if getattr(a, name, None) is None and value is not None and hasattr(a, name):
            setattr(a, name, str(files.resolve(config, value)) if section == "paths" and name != "password" else value)
    for name, value in _DEFAULTS.items():
        if getattr(a, name, 0) is None:
            setattr(a, name, value)
    if lost := [n for n in needed if getattr(a, n) is None]:
        raise ValueError(f"neither the options nor a configuration name {lost}")
    return a


def init_db(spark, a):
    """A new study; one that is there stays as it is."""
    if not store.versions(a.study):
        store.save(S.empty_study(spark), a.study, operation="init-db")


def _unplanned(study: store.Study) -> store.Study:
    """A study without tasks; raises if it has some."""
    if not study["tasks"].isEmpty():
        raise ValueError("the study has tasks already: prepare a new one in another folder")
    return study


def prepare_study(spark, a):
    a = _configured(a)
    if store.versions(a.study):
        _unplanned(store.load(spark, a.study))
    test, train = _split(spark, a.test), _split(spark, a.train)
    votes = files.votes(spark, a.votes)
    needed = ("clip_id", "original_frame_count", "mean_abs_change")
    stimulus = files.csv(spark, a.stimulus, "clip_id int, original_frame_count double, mean_abs_change double", needed) if a.stimulus else None
    if stimulus is not None and not files.stimulus_audit(stimulus, test.select("clip_id").union(train.select("clip_id"))).isEmpty():
        raise ValueError("stimulus features must hold each clip once")
    if a.duplicates and files.exists(spark, a.duplicates):
        train = design.excluded_duplicates(train, files.csv(spark, a.duplicates, "clip_id_1 int, clip_id_2 int"))
    subset = design.alignment_subset(train, design.label_clarity(votes, files.VOTE_COLUMNS), stimulus, a.per_class)
    sizes = train.groupBy("label").agg(F.count("*").alias("n"))
    wrong = design.class_count_errors(subset, sizes.select("label", F.when(F.col("label") == design.WHOLE_LABEL, F.col("n")).otherwise(F.least("n", F.lit(a.per_class))).alias("expected")))
    if found := wrong.take(7):
        raise ValueError(f"the alignment subset has unexpected class counts: {found}")
    chosen = test.select("clip_id").union(subset.select("clip_id"))
    if found := chosen.distinct().join(_whole_clips(spark, a), "clip_id", "left_anti").take(10):
        raise ValueError(f"the frame source lacks selected clips, such as {[r.clip_id for r in found]}")
    tasks, work = design.prepare_study(test, subset, a.raters, a.second, a.hidden, a.gap)
    people = spark.createDataFrame([(c, c, 1) for c in a.raters], "code string, display_name string, active int")
    meta = {"design_version": "1", "frame_second_fraction": a.second, "hidden_repeat_fraction": a.hidden, "minimum_clip_gap": a.gap, "test_clips": test.count(), "independent_annotators": ",".join(a.raters)}
    meta = spark.createDataFrame([(k, str(v)) for k, v in meta.items()], "key string, value string")
    store.update(spark, a.study, lambda study: _unplanned(study) | {"tasks": tasks, "assignments": work, "annotators": people, "study_meta": meta}, "prepare-study")
    if a.selection:
        files.write_csv(subset, a.selection, order=["label", "clip_id"])


def select_calibration(spark, a):
    """The clearest clips of each class and those at its border, of clips that are not tested. What the main study uses is
    read from it if it is there, else selected as it will be."""
    a = _configured(a, () if store.versions(a.study) else ("test", "train", "votes", "frames"))
    votes = files.votes(spark, a.votes)
    if not design.vote_violations(votes, files.VOTE_COLUMNS).isEmpty():
        raise ValueError("votes must not be negative and must add up to 10")
    clarity = design.label_clarity(votes, files.VOTE_COLUMNS, validate=True)
    if store.versions(a.study):
        tasks = store.load(spark, a.study)["tasks"]
        used, tested = (tasks.where(F.col("split") == x).select("clip_id").distinct() for x in ("train_alignment", "test"))
    else:
        tested, train = _split(spark, a.test).select("clip_id"), _split(spark, a.train)
        stimulus = files.csv(spark, a.stimulus, "clip_id int, original_frame_count double, mean_abs_change double", ("clip_id",)) if a.stimulus else None
        used = design.alignment_subset(train, clarity, stimulus, a.per_class).select("clip_id")
    own = clarity.join(votes.select(F.col("order").alias("clip_id"), "label"), "clip_id")
    rows = own.join(tested, "clip_id", "left_anti").join(used.withColumn("main_study_overlap", F.lit(True)), "clip_id", "left").fillna(False, ["main_study_overlap"])
    if a.frames:
        rows = rows.join(_whole_clips(spark, a), "clip_id", "left_semi")
    if found := design.calibration_shortfall(rows, a.clips).take(7):
        raise ValueError(f"too few eligible calibration clips: {found}")
    picked = design.calibration_frames(design.calibration_selection(rows, a.clips))
    files.write_csv(picked, f"{a.output}/key.csv", order=["label", "calibration_profile", "clip_id"])
    files.write_csv(design.calibration_manifest(picked), f"{a.output}/manifest.csv", ["clip_id", "task_type", "frame_index"], ["place"])


def prepare_calibration(spark, a):
    manifest = files.csv(spark, a.manifest, "clip_id int, task_type string, frame_index int", ("clip_id", "task_type"), line="line")
    if "frame_index" not in manifest.columns:
        manifest = manifest.withColumn("frame_index", F.lit(None).cast("int"))
    if not files.manifest_violations(manifest).isEmpty():
        raise ValueError("the manifest names other task types or frames than there are")
    place = F.row_number().over(design.Window.partitionBy(F.lit(1)).orderBy("line"))  # a manifest is a few dozen rows
    manifest = manifest.withColumns({"position": place, "frame_index": F.when(F.col("task_type") == "frame", F.col("frame_index"))})
    setting = spark.createDataFrame([("calibration_tasks", str(manifest.count()))], "key string, value string")

    def change(study: store.Study) -> store.Study:
        tasks, work = design.prepare_calibration(manifest, study["annotators"], study["tasks"], study["assignments"], a.raters)
        return study | {"tasks": tasks, "assignments": work, "study_meta": exchange.upserted(study["study_meta"], setting, ["key"])}

    store.update(spark, a.study, change, "prepare-calibration")


def calibration_report(spark, a):
    rated = _rated(store.load(spark, a.study), frames_too=True).where("split = 'calibration'")
    named = rated.select("task_uuid", "task_type", "clip_id", F.col("frame_index").alias("frame")).distinct()
    report = agreement.calibration_report(rated).join(named, "task_uuid")
    columns = ["task_type", "clip_id", "frame", "n_completed", "category_unanimous", "categories", "mean_pairwise_intensity_gap"]
    files.write_csv(report, a.output, columns, ["task_type", "clip_id", "frame"])
    agreement.calibration_summary(report).show()


def prepare_practice(spark, a):
    """A practice study in a folder of its own, of clips that the formal study does not use."""
    if store.versions(a.study) and not a.force:
        print(f"{a.study} holds a practice study already")
        return
    formal = store.load(spark, a.formal)["tasks"] if a.formal and store.versions(a.formal) else S.empty_study(spark)["tasks"]
    practice = design.practice_study(design.practice_set(_whole_clips(spark, a), formal), exchange.PRACTICE_RATER)
    store.save(S.empty_study(spark) | practice, a.study, operation="prepare-practice")


def reset_practice(spark, a):
    def change(study: store.Study) -> store.Study:
        if not exchange.may_reset(study, a.rater):
            raise ValueError(f"only {exchange.PRACTICE_RATER}'s work in a practice study is reset")
        return exchange.reset_practice(study, a.rater)

    store.update(spark, a.study, change, "reset-practice")


def annotator_check(spark, a):
    """Whether a rater's bundle can be worked on: one rater, whole clips, and images that can be read at the first, middle
    and last of its targets."""
    study = store.load(spark, a.study)
    if study["annotators"].where("active = 1").count() != 1:
        raise ValueError("a rater's bundle holds exactly one active rater")
    targets = integrity.targets(_assigned(study), "annotator_code")
    if found := targets.select("clip_id").distinct().join(_whole_clips(spark, a), "clip_id", "left_anti").take(8):
        raise ValueError(f"the frame source lacks clips of the tasks, such as {[r.clip_id for r in found]}")
    for r in progress.probes(targets, "annotator_code", "clip_id", "frame_index").collect():  # at most three
        if not frames.frame(frames.frames(spark, a.frames, a.password), r.clip_id, r.frame_index):
            raise ValueError(f"the image of clip {r.clip_id}, frame {r.frame_index} is empty")


def status(spark, a):
    progress.status_counts(_assigned(store.load(spark, a.study)), "annotator_code", "task_type", "split").orderBy("annotator_code", "task_type", "split").show(200)


def next_task(spark, a):
    progress.next_task(_assigned(store.load(spark, a.study))).show()


def workload_report(spark, a):
    files.write_csv(progress.workload(_assigned(store.load(spark, a.study))), a.output, order=["annotator_code", "task_type", "split"])


def backup(spark, a):
    files.snapshot(store.load(spark, a.study), a.output)


def make_annotator_bundle(spark, a):
    """A rater's own study in a new folder, with a practice beside it and the settings that the rater's machine needs."""
    study = store.load(spark, a.study)
    if study["annotators"].where(F.col("code") == a.rater).isEmpty():
        raise ValueError(f"the study has no rater {a.rater}")
    store.save(exchange.rater_bundle(study, a.rater), a.output, operation="make-annotator-bundle")
    if a.practice and store.versions(a.practice):
        store.save(store.load(spark, a.practice), f"{a.output}/practice", operation="make-annotator-bundle")
    if a.config:
        paths = files.load_config(a.config).get("paths", {})
        own = {k: paths[k] for k in ("frames", "frames_16_archive", "frames_archive_password") if k in paths}
        files.write_text(f"{a.output}/project.toml", "[paths]\n" + "".join(f"{k} = {json.dumps(str(v))}\n" for k, v in own.items()))


def export(spark, a):
    study = store.load(spark, a.study)
    if study["annotators"].where(F.col("code") == a.rater).isEmpty():
        raise ValueError(f"the study has no rater {a.rater}")
    out = exchange.export_results(study, a.rater)
    out["clip_ratings"] = _as_json(out["clip_ratings"])
    for name, columns in _columns().items():
        files.write_csv(out[name], f"{a.output}/{name}.csv", columns, ["queue_position", "assignment_uuid"] if name == "assignments" else ["assignment_uuid"])
    files.write_text(f"{a.output}/bundle.json", files.bundle_json(out["bundle"]).first().value)


def _as_json(clips: DataFrame) -> DataFrame:
    """Clip ratings with their curves as texts of whole numbers, as bundles have them."""
    whole = F.to_json(F.transform("intensities", lambda x: x.cast("int")))
    return clips.withColumn("intensities_json", whole).drop("intensities")


def _columns() -> dict[str, list[str]]:
    return {t: [c.split()[0] for c in kinds.split(", ")] for t, kinds in _RATING_CSV.items()}


def export_package(spark, a):
    """A rater's finished work as files: refused in a practice, and until all assignments are complete."""
    study = store.load(spark, a.study)
    if not study["study_meta"].where("key = 'practice_mode' AND value = '1'").isEmpty():
        raise ValueError("a practice is not exported")
    own = exchange.rater_bundle(study, a.rater)
    counts = progress.status_counts(_assigned(own), "annotator_code", "task_type", "split")
    gate = progress.completion_gate(counts, "annotator_code").first()
    if gate is None or not gate.all_complete:
        raise ValueError(f"{a.rater} has not completed all assignments")
    about = exchange.export_results(study, a.rater)["bundle"].first().asDict()
    about |= {"exported_at": about["exported_at"].isoformat(), "design_version": about["design_version"] or "unknown", "total_assignments": about["completed_assignments"]}
    tasks = own["tasks"].join(own["assignments"].select("task_uuid", "queue_position"), "task_uuid")
    columns = _columns() | {"tasks": [f.name for f in S.schema("tasks").fields]}
    rows = {"assignments": own["assignments"], "tasks": tasks, "frame_ratings": own["frame_ratings"], "clip_ratings": _as_json(own["clip_ratings"])}
    order = {"assignments": "queue_position", "tasks": "queue_position"}
    files.package(spark, about, {t: (df, columns[t], order.get(t, "assignment_uuid")) for t, df in rows.items()}, a.output)


def release_check(spark, a):
    if found := files.release_findings(spark, a.folder).take(30):
        raise ValueError(f"not to be published: {[tuple(r) for r in found]}")


def merge(spark, a):
    """Takes in bundles, all or none; if the study changes meanwhile, they are checked against it anew."""
    bundles = files.bundle_folders(spark, a.folders, _RATING_CSV)
    store.update(spark, a.study, lambda study: exchange.merged(study, bundles), "merge")


def create_adjudications(spark, a):
    def change(study: store.Study) -> store.Study:
        new = agreement.new_adjudications(_rated(study), study["tasks"], study["annotators"], study["assignments"])
        new.where("problem IS NOT NULL").select("task_uuid", "problem").show(30)
        good = new.where("problem IS NULL AND NOT assigned")
        work = exchange.inserted(study["assignments"], good.select("assignment_uuid", "task_uuid", "annotator_code", "role", "queue_position", F.lit("pending").alias("status")), ["assignment_uuid"])
        return study | {"assignments": work, "adjudication_cases": agreement.refreshed_cases(study["adjudication_cases"], new)}

    store.update(spark, a.study, change, "create-adjudications")


def export_consensus(spark, a):
    study = store.load(spark, a.study)
    agreed = agreement.consensus(_rated(study), carry=("clip_id", "split"))
    work = study["assignments"].join(study["tasks"], "task_uuid").join(study["frame_ratings"], "assignment_uuid")
    rows = work.select("task_uuid", "source_task_uuid", "annotator_code", "role", "duration_ms", "clip_id", F.col("frame_index").alias("frame"), "repeat_kind", F.col("visible_category").alias("category"), "intensity", "submitted_at", "split")
    main = rows.where("split <> 'calibration'")
    if not agreement.primary_duplicates(main).isEmpty():
        raise ValueError("a test frame has more than one primary rating")
    files.write_csv(agreement.consensus_table(agreed), f"{a.output}/trajectory_consensus.csv", order=["split", "clip_id"])
    files.write_csv(agreement.adjudication_table(agreed), f"{a.output}/adjudications.csv", order=["split", "clip_id"])
    files.write_csv(main.where("repeat_kind = 'none'").withColumnRenamed("category", "visible_category"), f"{a.output}/frame_primary.csv", ["clip_id", "frame", "annotator_code", "visible_category", "intensity"], ["clip_id", "frame"])
    files.write_csv(agreement.reliability_pairs(main), f"{a.output}/frame_reliability_pairs.csv", order=["clip_id", "frame", "repeat_kind"])
    files.write_csv(agreement.raw_frames(rows), f"{a.output}/frame_ratings.csv.gz", order=["clip_id", "frame", "annotator_code", "task_uuid"], compression="gzip")
    files.write_csv(agreement.raw_clips(study["assignments"], study["tasks"], study["clip_ratings"]), f"{a.output}/clip_ratings.csv.gz", order=["split", "clip_id", "annotator_code", "role"], compression="gzip")


def validate_study(spark, a):
    """Shows what is wrong with a study, and ends with an error if anything is."""
    study = store.load(spark, a.study)
    meta = {r.key: r.value for r in study["study_meta"].collect()}  # a handful of settings
    problems = integrity.constraint_violations(study).unionAll(integrity.study_violations(study, int(meta.get("test_clips", 0)), int(meta.get("minimum_clip_gap", 9)), a.require_complete))
    found = problems.take(30)
    for r in found:
        print(f"{r.check}: {r.subject} {r.detail or ''}")
    if found:
        raise SystemExit(1)


#: The settings of the demo study.
_DEMO = """[paths]
frames = "frames"
annotation_xlsx = "votes.csv"
train_csv = "train.csv"
test_csv = "test.csv"

[study]
annotators = ["R01", "R02"]
frame_second_rating_fraction = 0.10
frame_hidden_repeat_fraction = 0.02
frame_minimum_clip_gap = 2
training_per_non_disgust_class = 380
"""


def make_demo(spark, a):
    """A folder with all that prepare-study takes. Its frames are stand-ins for images, which no operator decodes."""
    clips, votes = design.demo_study(spark)
    rename = [F.col("clip_id").alias("video_name"), "label"]
    for split in ("test", "train"):
        files.write_csv(clips.where(F.col("split") == split).select(*rename), f"{a.output}/{split}.csv", order=["video_name"])
    files.write_csv(votes, f"{a.output}/votes.csv", order=["order"])
    for r in clips.select("clip_id").collect():  # 21 clips
        for n in range(1, S.CURVE_POINTS + 1):
            files.write_text(f"{a.output}/frames/{r.clip_id:05d}/{frames.FILE.format(n)}", f"demo clip {r.clip_id}, frame {n}")
    files.write_text(f"{a.output}/project.toml", _DEMO)


#: Each command with the options it takes beside --study.
COMMANDS = {
    init_db: {}, status: {}, next_task: {}, create_adjudications: {},
    prepare_study: {"config": {"default": None}, "test": {"default": None}, "train": {"default": None}, "votes": {"default": None}, "stimulus": {"default": None}, "duplicates": {"default": None}, "frames": {"default": None}, "password": {"default": None}, "selection": {"default": None}, "raters": {"nargs": "+", "default": None}, "second": {"type": float, "default": None}, "hidden": {"type": float, "default": None}, "gap": {"type": int, "default": None}, "per-class": {"type": int, "default": None}},
    select_calibration: {"config": {"default": None}, "test": {"default": None}, "train": {"default": None}, "votes": {"default": None}, "stimulus": {"default": None}, "output": {}, "frames": {"default": None}, "password": {"default": None}, "per-class": {"type": int, "default": None}, "clips": {"type": int, "default": 4}},
    export_package: {"rater": {}, "output": {}}, release_check: {"folder": {}},
    prepare_calibration: {"manifest": {}, "raters": {"type": int, "default": 3}},
    calibration_report: {"output": {}}, reset_practice: {"rater": {}}, annotator_check: {"frames": {}, "password": {"default": None}},
    prepare_practice: {"frames": {}, "password": {"default": None}, "formal": {"default": None}, "force": {"action": "store_true"}},
    workload_report: {"output": {}}, backup: {"output": {}}, make_annotator_bundle: {"rater": {}, "output": {}, "practice": {"default": None}, "config": {"default": None}}, export: {"rater": {}, "output": {}},
    merge: {"folders": {"nargs": "+"}}, export_consensus: {"output": {}}, validate_study: {"require-complete": {"action": "store_true"}}, make_demo: {"output": {}},
}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ratelens", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for run, options in COMMANDS.items():
        own = commands.add_parser(run.__name__.replace("_", "-"))
        own.add_argument("--study", type=Path, required=run not in (make_demo, release_check))
        for name, kind in options.items():
            own.add_argument(f"--{name}", **({"required": True} | kind if "default" not in kind and "action" not in kind else kind))
        own.set_defaults(run=run)
    a = parser.parse_args(args)
    a.run(spark or session(), a)


if __name__ == "__main__":
    main()
