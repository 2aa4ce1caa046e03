"""A whole study made from the driver's tables, and the queries that work on studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import agreement, design, exchange, integrity, progress
from ..schemas import CATEGORIES, CURVE_POINTS
from ..shared import written
from ..sources import frames
from . import adapters
from .adapters import load

Study = dict[str, DataFrame]


def _with_prefix(prefix: str, number: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(number) if isinstance(number, str) else number).cast("string"))


def _where(condition: str, value, otherwise: Column) -> Column:
    return F.when(F.expr(condition), F.lit(value)).otherwise(otherwise)


def study(spark: SparkSession, sf_dir: str, faults: bool = False) -> Study:
    """Regions are raters (the first three active), events frame tasks, vectors clip tasks of two raters and, every
    fourth, an adjudicator. faults puts a violation of each kind into some rows."""
    fault = lambda condition, value, column: _where(condition, value, column) if faults else column
    regions = load(spark, sf_dir, "region")
    key = _with_prefix("R", "r_regionkey")
    people = regions.select(key.alias("code"), F.col("r_name").alias("display_name"), fault("r_regionkey = 4", 2, (F.col("r_regionkey") < 3).cast("int")).alias("active"))
    settings = "'design_version', '1', 'test_clips', '7', 'minimum_clip_gap', '3'"
    meta = regions.where("r_regionkey = 0").select(F.explode(F.expr(f"map({settings})")))
    if faults:
        meta = meta.unionByName(meta)
    events = adapters.frame_ratings(spark, sf_dir).withColumnRenamed("task_uuid", "id")
    role = F.when(F.col("repeat_kind") == "none", "primary").when(F.col("repeat_kind") == "second_rater", "second").otherwise("hidden_repeat")
    rater = _with_prefix("R", F.col("id") % 3)
    work_id = F.concat(_with_prefix("f", "id"), F.lit("-"), rater)
    status = F.when(F.col("id") % 4 == 0, "pending").when(F.col("id") % 4 == 1, "started").otherwise("complete")
    frame_tasks = events.select(_with_prefix("f", "id").alias("task_uuid"), F.lit("frame").alias("task_type"), F.lit("test").alias("split"), F.col("clip_id").cast("int").alias("clip_id"), fault("id % 89 = 0", 17, fault("id % 97 = 0", None, F.col("id") % 16 + 1)).cast("int").alias("frame_index"), fault("id % 83 = 0", "gone", _with_prefix("f", "source_task_uuid")).alias("source_task_uuid"), fault("id % 101 = 0", "again", F.col("repeat_kind")).alias("repeat_kind"))
    frame_work = events.select(work_id.alias("assignment_uuid"), _with_prefix("f", "id").alias("task_uuid"), fault("id % 73 = 0", "R9", rater).alias("annotator_code"), fault("id % 79 = 0", "guest", role).alias("role"), F.col("id").cast("int").alias("queue_position"), status.alias("status"), (F.col("id") * 10).alias("duration_ms"))
    frame_ratings = events.where(status == "complete").select(fault("id % 61 = 0", "lost", work_id).alias("assignment_uuid"), fault("id % 67 = 0", "Boredom", F.col("category")).alias("visible_category"), fault("id % 71 = 0", 7, F.col("intensity")).cast("int").alias("intensity"))
    drafts = events.where("id % 4 = 1").select(work_id.alias("assignment_uuid"), fault("id % 59 = 0", None, F.lit("{}")).cast("string").alias("payload_json"))
    clips = adapters.clip_ratings(spark, sf_dir).withColumnsRenamed({"task_uuid": "id", "role": "_role"}).withColumn("k", F.substring("annotator_code", 3, 1).cast("int"))
    label = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    clip_tasks = label.select(_with_prefix("c", "id").alias("task_uuid"), F.lit("clip").alias("task_type"), F.element_at(F.array(*map(F.lit, ("test", "train_alignment", "calibration"))), (F.col("label") % 3 + 1).cast("int")).alias("split"), F.col("id").cast("int").alias("clip_id"), F.lit(None).cast("int").alias("frame_index"), F.lit(None).cast("string").alias("source_task_uuid"), F.lit("none").alias("repeat_kind"))
    clips = clips.where("k < 3 OR id % 4 = 0").withColumn("rater", _with_prefix("R", (F.col("id") + F.col("k")) % 3))
    clips = clips.withColumns({"work": F.concat(_with_prefix("c", "id"), F.lit("-"), F.col("rater")), "status": F.when((F.col("k") == 2) & (F.col("id") % 7 == 3), "started").otherwise("complete")})
    first = _with_prefix("R", (F.col("id") + 1) % 3)
    twice = "k = 2 AND id % 11 = 0"  # the second rater's work as the first's once more
    clip_role = F.element_at(F.array(*map(F.lit, ("primary", "second", "adjudication"))), F.col("k"))
    clip_work = clips.select(F.col("work").alias("assignment_uuid"), _with_prefix("c", "id").alias("task_uuid"), (F.when(F.expr(twice), first).otherwise(F.col("rater")) if faults else F.col("rater")).alias("annotator_code"), fault(twice, "primary", clip_role).alias("role"), (F.col("id") * 3 + F.col("k")).cast("int").alias("queue_position"), "status", (F.col("id") * 1000).alias("duration_ms"))
    curve = F.col("curve")
    if faults:
        curve = F.when(F.expr("id % 28 = 3"), F.slice("curve", 1, 15)).when(F.expr("id % 28 = 10"), F.concat(F.slice("curve", 1, 15), F.array(F.lit(7.0)))).otherwise(curve)
    clip_ratings = clips.where("status = 'complete'").select(F.col("work").alias("assignment_uuid"), F.col("category").alias("dominant_category"), curve.alias("intensities"), F.lit(0).alias("occlusion"), fault("id % 13 = 0", 2, F.lit(0)).alias("speaking"), F.lit(0).alias("abrupt_change"), F.lit(1).alias("subject_switch"))
    cases = label.where("id % 8 = 0").select(_with_prefix("c", "id").alias("task_uuid"), F.array(F.lit("category")).alias("reasons"), fault("id % 5 = 0", "lost", F.when(F.col("id") % 16 == 0, "complete").otherwise("pending")).alias("status"))
    log = regions.where("r_regionkey = 0").select(F.lit("B0").alias("bundle_id"), F.current_timestamp().alias("imported_at"), F.lit("x").alias("source_path"), F.lit(1).alias("rows_imported"))
    return {
        "study_meta": meta, "annotators": people, "tasks": frame_tasks.unionByName(clip_tasks), "assignments": frame_work.unionByName(clip_work),
        "frame_ratings": frame_ratings, "clip_ratings": clip_ratings, "drafts": drafts, "import_log": log, "adjudication_cases": cases,
    }


def rated(study: Study) -> DataFrame:
    """Clip ratings with their tasks and raters."""
    work = study["assignments"].join(study["tasks"].where("task_type = 'clip'").select("task_uuid", "clip_id", "split"), "task_uuid")
    return work.join(study["clip_ratings"], "assignment_uuid").select("task_uuid", "clip_id", "split", "annotator_code", "role", F.col("dominant_category").alias("category"), F.col("intensities").alias("curve"))


def _named(tables: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """Rows (kind, id, value) of several tables."""
    out = None
    for kind, df, key, value in tables:
        rows = df.select(F.lit(kind).alias("kind"), key.cast("string").alias("id"), value.cast("string").alias("value"))
        out = rows if out is None else out.unionAll(rows)
    return out


def constraint_violations(spark, sf):
    return integrity.constraint_violations(study(spark, sf, faults=True))


def study_violations(spark, sf):
    return integrity.study_violations(study(spark, sf, faults=True), 7, 3, require_complete=True)


def save_ratings(spark, sf):
    """Two submissions of all events: some break a rule or name an unknown assignment, every fifth is sent again."""
    own = study(spark, sf)
    events = adapters.frame_ratings(spark, sf).withColumnRenamed("task_uuid", "id")
    work = F.when(F.col("id") % 61 == 0, "lost").otherwise(F.concat(_with_prefix("f", "id"), F.lit("-"), _with_prefix("R", F.col("id") % 3)))
    at = lambda n: F.timestamp_seconds(F.lit(1_700_000_000 + n))
    first = events.select(work.alias("assignment_uuid"), F.when(F.col("id") % 11 == 0, "Boredom").otherwise(F.col("category")).alias("visible_category"), F.when(F.col("id") % 13 == 0, 9).otherwise(F.col("intensity")).alias("intensity"), at(0).alias("submitted_at"), ((F.col("id") - 100) * 100_000).alias("duration_ms"))
    again = events.where("id % 5 = 0").select(work.alias("assignment_uuid"), F.lit("Mixed").alias("visible_category"), F.lit(3).alias("intensity"), at(60).alias("submitted_at"), F.lit(5).cast("long").alias("duration_ms"))
    own["frame_ratings"] = own["frame_ratings"].withColumn("submitted_at", at(-60))
    own["assignments"] = own["assignments"].withColumns({"started_at": at(-90), "completed_at": F.lit(None).cast("timestamp")})
    done, rejected = exchange.save_ratings(own, "frame_ratings", first.unionByName(again))
    assert_one = F.concat_ws("/", "status", "duration_ms")
    return _named([
        ("assignment", done["assignments"].where("task_uuid LIKE 'f%'"), F.col("assignment_uuid"), assert_one), ("rating", done["frame_ratings"], F.col("assignment_uuid"), F.concat_ws("/", "visible_category", "intensity")),
        ("draft", done["drafts"], F.col("assignment_uuid"), F.lit("")), ("rejected", rejected, F.col("assignment_uuid"), F.col("error")),
    ])


def merged_study(spark, sf):
    """Bundles of three raters, the first of which is imported already; two say different things of the same work."""
    own = study(spark, sf)
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    for t in ("frame_ratings", "clip_ratings"):
        own[t] = own[t].withColumn("submitted_at", at)
    own["assignments"] = own["assignments"].withColumns({"started_at": at, "completed_at": at})
    bundle = spark.range(4).select(F.concat(F.lit("B"), "id").alias("bundle_id"), F.lit("1").alias("design_version"), F.lit("x").alias("source_path"), F.col("id").cast("int").alias("number"))
    work = own["assignments"].where("task_uuid LIKE 'f%'").withColumn("id", F.substring_index(F.substring("task_uuid", 2, 20), "-", 1).cast("long"))
    sent = work.withColumn("n", F.explode(F.when(F.col("id") % 3 == 2, F.array(F.lit(2), F.lit(3))).otherwise(F.array((F.col("id") % 3).cast("int")))))
    sent = sent.withColumns({"bundle_id": _with_prefix("B", "n"), "duration_ms": F.col("id") * 20 + F.col("n"), "status": F.lit("started")})
    ratings = sent.select("bundle_id", "assignment_uuid", F.element_at(F.array(*map(F.lit, CATEGORIES)), ((F.col("id") + F.col("n")) % 10 + 1).cast("int")).alias("visible_category"), F.col("n").alias("intensity"), F.when(F.col("id") % 2 == 0, at).alias("submitted_at"))
    done = exchange.merged(own, {"bundle": bundle, "assignments": sent.drop("id", "n"), "frame_ratings": ratings, "clip_ratings": own["clip_ratings"].limit(0).withColumn("bundle_id", F.lit(None).cast("string"))})
    return _named([
        ("assignment", done["assignments"], F.col("assignment_uuid"), F.concat_ws("/", "status", "duration_ms")), ("rating", done["frame_ratings"], F.col("assignment_uuid"), F.concat_ws("/", "visible_category", "intensity")),
        ("log", done["import_log"], F.col("bundle_id"), F.col("rows_imported")), ("unset", done["frame_ratings"].where("submitted_at IS NULL"), F.col("assignment_uuid"), F.lit("")),
    ])


def merge_check(spark, sf):
    own = study(spark, sf)
    number = F.substring("assignment_uuid", 2, 20)
    odd = own["assignments"].withColumn("assignment_uuid", F.when(number.like("%7-%"), F.concat("assignment_uuid", F.lit("x"))).otherwise(F.col("assignment_uuid"))).withColumn("task_uuid", F.when(number.like("%3-%"), F.lit("t")).otherwise(F.col("task_uuid"))).withColumn("role", F.lit("any"))
    return exchange.merge_problems(own, {"assignments": odd})


def rating_problems(spark, sf):
    """Ratings with faults, of assignments of which the study knows all but some."""
    broken = study(spark, sf, faults=True)
    return exchange.rating_problems(study(spark, sf), broken)


def raw_clips(spark, sf):
    own = study(spark, sf)
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    return agreement.raw_clips(own["assignments"], own["tasks"], own["clip_ratings"].withColumn("submitted_at", at)).withColumn("submitted_at", F.unix_seconds("submitted_at"))


def raw_frames(spark, sf):
    own = study(spark, sf)
    rows = own["assignments"].join(own["tasks"], "task_uuid").join(own["frame_ratings"], "assignment_uuid").withColumn("submitted_at", F.lit(0))
    return agreement.raw_frames(rows.withColumnsRenamed({"visible_category": "category", "frame_index": "frame"}))


def calibration_queue(spark, sf):
    """Nations as a manifest, in the order of their names, ahead of all that the active raters have."""
    own = study(spark, sf)
    own["tasks"] = own["tasks"].withColumn("split", F.regexp_replace("split", "calibration", "test"))
    place = F.row_number().over(design.Window.partitionBy(F.lit(1)).orderBy("n_name"))
    is_frame = F.col("n_nationkey") % 2 == 0
    manifest = load(spark, sf, "nation").select(place.alias("position"), F.col("n_nationkey").alias("clip_id"), F.when(is_frame, "frame").otherwise("clip").alias("task_type"), F.when(is_frame, F.col("n_nationkey") % 16 + 1).cast("int").alias("frame_index"))
    tasks, work = design.prepare_calibration(manifest, own["annotators"], own["tasks"], own["assignments"])
    split = tasks.select("task_uuid", F.when(F.col("split") == "calibration", F.concat_ws("/", "task_type", "clip_id", "frame_index")).alias("calibration"))
    rows = work.select("task_uuid", "annotator_code", "queue_position").join(split, "task_uuid")
    return rows.select("annotator_code", F.coalesce("calibration", "task_uuid").alias("task"), F.col("queue_position").cast("int").alias("queue_position"))


def calibration_manifest(spark, sf):
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("clip_id"), F.col("lang").alias("label"), "n_chars", (F.col("doc_id") % 2 == 0).alias("main_study_overlap"))
    picked = design.calibration_selection(rows, 5, order=(F.col("n_chars").asc(), F.col("clip_id").asc()))
    return design.calibration_manifest(design.calibration_frames(picked)).withColumn("place", F.col("place").cast("int"))


def rater_bundle(spark, sf):
    own = exchange.rater_bundle(study(spark, sf), "R1")
    ids = {"annotators": "code", "study_meta": "key", "import_log": "bundle_id", "tasks": "task_uuid", "adjudication_cases": "task_uuid"}
    return _named([(t, df, F.col(ids.get(t, "assignment_uuid")), F.col("value") if t == "study_meta" else F.lit("")) for t, df in own.items()])


def export_results(spark, sf):
    own = exchange.export_results(study(spark, sf), "R1")
    return _named([(t, own[t], F.col("assignment_uuid"), F.lit("")) for t in ("assignments", "frame_ratings", "clip_ratings")] + [("bundle", own["bundle"], F.col("bundle_id"), F.concat_ws("/", "annotator", "design_version", "completed_assignments"))])


def new_adjudications(spark, sf):
    own = study(spark, sf)
    found = agreement.new_adjudications(rated(own), own["tasks"], own["annotators"], own["assignments"])
    cases = agreement.refreshed_cases(own["adjudication_cases"], found)
    rows = found.select("task_uuid", "annotator_code", "queue_position", "assigned")
    return cases.select("task_uuid", F.array_join("reasons", "|").alias("reasons"), "status").join(rows, "task_uuid", "left")


def unassignable_adjudications(spark, sf):
    """With the third rater gone, no disagreement of two can be settled."""
    own = study(spark, sf)
    people = own["annotators"].withColumn("active", F.when(F.col("code") == "R2", 0).otherwise(F.col("active")))
    return agreement.new_adjudications(rated(own), own["tasks"], people, own["assignments"]).select("task_uuid", "annotator_code", "queue_position", "problem")


def consensus_export(spark, sf):
    ratings = adapters.two_and_adjudicator(adapters.clip_ratings(spark, sf)).withColumns({"clip_id": F.col("task_uuid"), "split": F.lit("test")})
    rows = agreement.consensus_table(agreement.consensus(ratings, carry=("clip_id", "split")))
    return rows.select("clip_id", "split", "n_ratings", "dominant_category", "intensities_json", "adjacent_differences_json", "peak_type")


def adjudication_export(spark, sf):
    ratings = adapters.two_and_adjudicator(adapters.clip_ratings(spark, sf)).withColumns({"clip_id": F.col("task_uuid"), "split": F.lit("test")})
    return agreement.adjudication_table(agreement.consensus(ratings, carry=("clip_id", "split")))


def study_design(spark, sf):
    """How many assignments a new study has of each kind, and whether its queues have no holes."""
    clips = load(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("clip_id"), (F.col("vec_id") % 7 + 1).cast("int").alias("label"), "vec_id")
    tasks, work = design.prepare_study(clips.where("vec_id % 2 = 0"), clips.where("vec_id % 2 = 1"), ["A", "B"])
    rows = work.drop("clip_id").join(tasks, "task_uuid")
    counts = rows.groupBy("split", "task_type", "role").agg(F.count_distinct("assignment_uuid").alias("n"))
    queue = rows.groupBy("annotator_code").agg(F.count("*").alias("n"), F.max("queue_position").alias("last"), F.count_distinct("queue_position").alias("places"))
    whole = queue.agg(F.bool_and((F.col("n") == F.col("last")) & (F.col("n") == F.col("places"))).alias("ok"), F.sum("n").alias("n"))
    near = integrity.gap_violations(rows.where("task_type = 'frame'"), "annotator_code", "clip_id", ["queue_position"], 9)
    checks = whole.select(F.lit("all").alias("split"), F.lit("queue").alias("task_type"), F.when(F.col("ok"), "whole").otherwise("holes").alias("role"), "n")
    return counts.unionByName(checks).unionByName(near.agg(F.lit("all").alias("split"), F.lit("frame").alias("task_type"), F.lit("too near").alias("role"), F.count("*").alias("n")))


def gap_schedule(spark, sf):
    """Each supplier's order lines as frame tasks of a clip, in an order that keeps a gap of two tasks; what must hold of it."""
    lines = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("annotator_code"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("assignment_uuid"), (F.col("l_partkey") % 11).alias("clip_id"))
    out = written(design.scheduled(lines, 2))
    placed = out.select("annotator_code", "clip_id", "position")
    near = integrity.gap_violations_of_placed(placed, "annotator_code", "clip_id", 2).select("annotator_code", F.lit(True).alias("near"))
    digest = F.conv(F.substring(F.md5("assignment_uuid"), 1, 8), 16, 10).cast("long")
    items = out.drop("clip_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "annotator_code", "assignment_uuid")  # no item twice in memory
    per = items.groupBy("annotator_code").agg(F.count("*").alias("n"), F.count_distinct("assignment_uuid").alias("items"), F.max("position").cast("long").alias("last"), F.sum(digest).alias("digest"))
    return per.join(near, "annotator_code", "left").withColumn("near", F.coalesce("near", F.lit(False)))


def complete_clips(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("clip_id"), (F.col("l_partkey") % (F.col("l_suppkey") % 7 + 10) + 1).alias("frame_index"))
    return frames.complete_clips(rows)


def clip_targets(spark, sf):
    own = study(spark, sf)
    return integrity.targets(progress.with_tasks(own["assignments"], own["tasks"], "clip_id", "frame_index"), "annotator_code")


def logins(spark, sf):
    entered = load(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("  r"), F.col("n_regionkey").cast("string"), F.lit(" ")).alias("text"))
    return progress.logged_in(study(spark, sf)["annotators"], entered).select("n_nationkey", "code")


def opened_work(spark, sf):
    own = study(spark, sf)
    own["assignments"] = own["assignments"].withColumn("started_at", F.lit(None).cast("timestamp"))
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    known = F.when(F.col("queue_position") % 3 == 0, F.col("assignment_uuid")).otherwise(F.concat(F.lit("lost-"), F.col("assignment_uuid")))
    seen = own["assignments"].select(known.alias("assignment_uuid"), at.alias("opened_at"))
    return exchange.opened(own, seen)["assignments"].select("assignment_uuid", "status", F.col("started_at").isNotNull().alias("opened"))


def open_drafts(spark, sf):
    own = study(spark, sf)
    at = lambda n: F.timestamp_seconds(F.lit(1_700_000_000 + n))
    own["drafts"] = own["drafts"].withColumn("updated_at", at(0))
    new = own["assignments"].select("assignment_uuid", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), "queue_position").select("assignment_uuid", F.concat_ws("/", "queue_position", "n").alias("payload_json"), F.timestamp_seconds(F.col("n") + 1_700_000_000).alias("updated_at"))
    known = F.when(F.col("payload_json").like("%7/%"), F.concat(F.lit("lost-"), F.col("assignment_uuid"))).otherwise(F.col("assignment_uuid"))
    return exchange.open_drafts(exchange.save_drafts(own, new.withColumn("assignment_uuid", known))).select("assignment_uuid", "payload_json")


def flags(spark, sf):
    return load(spark, sf, "labels").select("doc_id", C.flag(F.col("toxic")).alias("toxic"), C.flag(F.when(F.col("quality") == 1, F.col("quality"))).alias("good"), F.lit(CURVE_POINTS).alias("points"))


def times(spark, sf):
    text = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    form = F.when(F.col("o_orderkey") % 3 == 0, F.regexp_replace(text, " ", "T")).when(F.col("o_orderkey") % 3 == 1, "").otherwise(text)
    return load(spark, sf, "orders").select("o_orderkey", F.date_format(C.stamp(form), "yyyyMMddHHmmss").alias("at"))


QUERIES = {f.__name__: f for f in (constraint_violations, study_violations, save_ratings, merged_study, merge_check, rating_problems, raw_clips, raw_frames, calibration_queue, calibration_manifest, rater_bundle, export_results, new_adjudications, unassignable_adjudications, consensus_export, adjudication_export, study_design, gap_schedule, complete_clips, clip_targets, logins, opened_work, open_drafts, flags, times)}
