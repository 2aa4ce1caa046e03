"""The queries over the driver's tables and their DuckDB equivalents, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.trajectory import DESCRIPTORS, with_descriptors
from ..operators import agreement, capture, design, exchange, integrity, order, progress
from ..sources import files
from . import adapters, study, study_sql
from .adapters import load
from .sql import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _round(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query
def status_counts(spark, sf):
    return progress.status_counts(adapters.assigned(spark, sf), "annotator_code", "task_type", "split")


@query
def next_task(spark, sf):
    rows = progress.next_task(adapters.assigned(spark, sf), order=("queue_position", "task_uuid", "part"))
    return rows.select("annotator_code", "task_uuid", "queue_position", "part", "status")


@query
def workload(spark, sf):
    return _round(progress.workload(adapters.assigned(spark, sf)), "median_completed_seconds", "estimated_remaining_hours")


@query
def completion_gate(spark, sf):
    counts = progress.status_counts(adapters.assigned(spark, sf), "task_type", "split", "queue_position")
    return progress.completion_gate(counts.withColumn("complete", F.when(F.col("split") == "F", F.col("total")).otherwise(F.col("complete"))), "split", "queue_position")


@query
def rater_totals(spark, sf):
    rows = progress.status_counts(adapters.assigned(spark, sf), "annotator_code")
    return rows.withColumn("percent", F.round(C.percent_complete(F.col("complete"), F.col("total")), 6))


@query
def task_probes(spark, sf):
    rows = progress.probes(adapters.assigned(spark, sf), "annotator_code", "task_uuid", "queue_position", "part")
    return rows.select("annotator_code", "task_uuid", "queue_position", "part")


@query
def task_authorised(spark, sf):
    wanted = load(spark, sf, "orders").select(F.col("o_orderkey").alias("task_uuid"), F.col("o_custkey").alias("wanted_by"), F.lit("complete").alias("status"))
    return progress.owned_task(adapters.assigned(spark, sf), wanted, "task_uuid", "status").drop("status")


@query
def unassigned(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("task_uuid")).join(adapters.assigned(spark, sf).select("task_uuid"), "task_uuid", "left_anti")


@query
def vote_clarity(spark, sf):
    events = load(spark, sf, "events")
    votes = events.groupBy(F.col("user_id").alias("order")).agg(*[F.count_if(F.col("event_id") % 7 * (F.col("event_id") % 3) % 7 == i).alias(v) for i, v in enumerate(files.VOTE_COLUMNS)])
    return _round(design.label_clarity(votes, files.VOTE_COLUMNS), "vote_entropy")


@query
def quartile_bin(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return design.quartiles(rows, "quarter", "o_totalprice", ["o_orderkey"], ["o_orderstatus"]).select("o_orderkey", "quarter")


@query
def largest_remainder(spark, sf):
    keys = ["o_orderpriority", "o_orderstatus"]
    sizes = load(spark, sf, "orders").groupBy(*keys).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return design.largest_remainder(sizes.withColumn("_t", total), keys, F.bround(F.col("_t") * 0.1).cast("bigint"), F.col("n") * 0.1).select(*keys, "n", "allocated")


@query
def stratified_sample(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return design.stratified_sample(rows, ["o_orderpriority", "o_orderstatus"], 0.1, design.shuffled(7, "o_orderkey"))


@query
def alignment_subset(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("clip_id"), (F.col("doc_id") % 7 + 1).alias("label"), "n_chars")
    clarity = docs.select("clip_id", (F.col("clip_id") * 37 % 101 / 101.0).alias("vote_entropy"))
    stimulus = docs.select("clip_id", F.col("n_chars").alias("original_frame_count"), (F.col("clip_id") * 53 % 97 / 97.0).alias("mean_abs_change"))
    return design.alignment_subset(docs.select("clip_id", "label"), clarity, stimulus, per_class=60).select("clip_id", "label", "clarity_bin", "length_bin", "motion_bin")


@query
def alternating_primary(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return design.primary_turns(rows, "primary", ["o_orderstatus"], "o_orderkey", F.col("o_custkey") % 7).select("o_orderkey", "primary")


@query
def stable_uuid(spark, sf):
    rows = load(spark, sf, "orders")
    return rows.select("o_orderkey", C.stable_uuid("frame", "test", F.col("o_orderkey"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")), "primary").alias("task_uuid"))


@query
def bundle_ids(spark, sf):
    rows = load(spark, sf, "events").groupBy("user_id").agg(F.collect_list(F.col("event_id").cast("string")).alias("ids"))
    return rows.select("user_id", C.bundle_id(F.concat(F.lit("R"), F.col("user_id").cast("string")), F.col("ids")).alias("bundle_id"))


@query
def calibration_pick(spark, sf):
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("clip_id"), F.col("lang").alias("label"), "n_chars", (F.col("doc_id") % 2 == 0).alias("main_study_overlap"))
    picked = design.calibration_selection(rows, 5, order=(F.col("n_chars").asc(), F.col("clip_id").asc()))
    return design.calibration_frames(picked).select("label", "clip_id", "calibration_profile", "frame_index")


@query
def manifest_violations(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("clip_id"), F.when(F.col("l_linenumber") == 7, "image").when(F.col("l_linenumber") == 6, "clip").otherwise("frame").alias("task_type"), F.when(F.col("l_linenumber") < 5, F.col("l_suppkey") % 18).alias("frame_index"))
    return files.manifest_violations(rows)


@query
def practice_set(spark, sf):
    clips = load(spark, sf, "documents").select(F.col("doc_id").alias("clip_id"))
    return design.practice_set(clips, load(spark, sf, "labels").select(F.col("doc_id").alias("clip_id")))


@query
def gap_violations(spark, sf):
    rows = integrity.gap_violations(load(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"], 2, first_only=False)
    return rows.select("user_id", "event_type", "event_id", F.col("position").cast("int").alias("position"), F.col("previous").cast("int").alias("previous"))


@query
def gap_of_one_queue(spark, sf):
    """All events as the queue of a single rater."""
    rows = load(spark, sf, "events").withColumn("rater", F.lit("R"))
    return integrity.gap_violations(rows, "rater", "user_id", ["ts", "event_id"], 9, first_only=False).select("event_id", "position", "previous")


@query
def quarters_of_ties(spark, sf):
    """Quarters of a number that nine in ten rows lack and the others share with thousands."""
    rows = load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.floor(F.col("o_totalprice") / 200_000)).alias("v"))
    return design.quartiles(rows, "quarter", "v", ["o_orderkey"]).select("o_orderkey", "quarter")


@query
def medians_of_ties(spark, sf):
    """Exact medians by status and over all, of values that most rows share."""
    counts = load(spark, sf, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    own = order.exact_medians(counts, ["l_returnflag"], "l_quantity", "n", "median").select(F.col("l_returnflag").alias("grp"), "median")
    every = order.exact_medians(counts.groupBy("l_quantity").agg(F.sum("n").alias("n")), [], "l_quantity", "n", "median")
    return own.unionAll(every.select(F.lit("all").alias("grp"), "median"))


@query
def schedule_needs(spark, sf):
    lines = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("annotator_code"), (F.col("l_partkey") % 11).alias("clip_id"))
    return design.schedule_needs(lines, 4)


@query
def assignment_states(spark, sf):
    """Events as the log of their users' assignments; every 53rd resets what was before."""
    rows = load(spark, sf, "events")
    kind = F.when(F.col("event_id") % 53 == 0, "reset").when(F.col("event_id") % 5 == 0, "opened").when(F.col("event_id") % 5 == 1, "draft").when(F.col("event_id") % 5 == 2, "submitted").otherwise("activity")
    log = rows.select(F.format_string("%010d", "event_id").alias("event_id"), F.col("user_id").cast("string").alias("assignment_uuid"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("visible"), F.col("event_id").cast("string").alias("payload_json"), F.when(F.col("event_id") % 7 == 0, "Joy").otherwise("Fear").alias("visible_category"), (F.col("event_id") % 4).cast("int").alias("intensity"), (F.col("event_id") * 1000).alias("duration_ms"))
    out = capture.assignment_states(log.unionAll(log))  # each event comes twice
    return out.withColumns({c: F.unix_micros(c) for c in ("started_at", "completed_at")})


@query
def release_scan(spark, sf):
    """Documents as files of some names, their lines as the files' lines."""
    suffix = F.element_at(F.array(*map(F.lit, (".md", ".py", ".csv", ".JPG", ".npz", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, ("docs", "demo_data", "exports", "a/b"))), (F.col("doc_id") % 4 + 1).cast("int"))
    files_ = load(spark, sf, "documents").select(F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"), "text")
    lines = files_.select("path", F.posexplode(F.split("text", "\n"))).select("path", (F.col("pos") + 1).cast("long").alias("line"), F.col("col").alias("text"))
    return files.named_findings(files_).unionAll(files.line_findings(lines, [r"[Pp]assword", r"[a-z]+@[a-z]+\."]))


@query
def active_time(spark, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return progress.active_time(load(spark, sf, "events"), "user_id", (at / 1000).cast("bigint"), F.col("event_type") != F.lit("error"), 3_600_000, ("event_id",))


@query
def latest_draft(spark, sf):
    rows = load(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return exchange.latest(rows, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query
def trajectory_long(spark, sf):
    rows = adapters.clip_ratings(spark, sf)
    return rows.select("task_uuid", "annotator_code", F.posexplode("curve").alias("position", "intensity")).withColumn("position", F.col("position") + 1)


@query
def trajectory_wide(spark, sf):
    return adapters.clip_ratings(spark, sf).select("task_uuid", "annotator_code", "category", *C.wide_curve(F.col("curve")))


@query
def adjacent_differences(spark, sf):
    rows = with_descriptors(adapters.clip_ratings(spark, sf), "curve", "category")
    return rows.select("task_uuid", "annotator_code", F.posexplode("adjacent_differences").alias("position", "difference"))


_SCALARS = [d for d in DESCRIPTORS if d != "adjacent_differences"]


@query
def descriptors(spark, sf):
    rows = with_descriptors(adapters.clip_ratings(spark, sf), "curve", "category").select("task_uuid", "annotator_code", *_SCALARS)
    return _round(rows, "mean_intensity", "mean_absolute_adjacent_change")


@query
def disagreements(spark, sf):
    rows = agreement.disagreements(adapters.two_and_adjudicator(adapters.clip_ratings(spark, sf)))
    return rows.select("task_uuid", "needed", F.array_join("reasons", "|").alias("reasons"))


@query
def consensus(spark, sf):
    rows = agreement.consensus(adapters.two_and_adjudicator(adapters.clip_ratings(spark, sf)))
    rows = rows.select("task_uuid", "n_ratings", "category", "needed", *C.wide_curve(F.col("curve")), "apex_position", "peak_type", "peak_count", "mean_intensity")
    return _round(rows, "mean_intensity")


@query
def adjudication_records(spark, sf):
    agreed = agreement.consensus(adapters.two_and_adjudicator(adapters.clip_ratings(spark, sf)))
    return agreement.adjudication_records(agreed).select("task_uuid", "reasons", "third_annotator", "third_category", "final_category", "status")


@query
def reliability_pairs(spark, sf):
    return agreement.reliability_pairs(adapters.frame_ratings(spark, sf))


@query
def primary_duplicates(spark, sf):
    return agreement.primary_duplicates(adapters.frame_ratings(spark, sf).withColumn("frame", F.lit("any")))


@query
def calibration_report(spark, sf):
    return _round(agreement.calibration_report(adapters.clip_ratings(spark, sf)), "mean_pairwise_intensity_gap")


@query
def calibration_summary(spark, sf):
    return _round(agreement.calibration_summary(agreement.calibration_report(adapters.clip_ratings(spark, sf))), "unanimity", "mean_gap")


@query
def upsert(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = orders.select((F.col("o_orderkey") * 2).alias("o_orderkey"), F.lit(0.0).alias("o_totalprice"), F.lit("X").alias("o_orderstatus"))
    return exchange.upserted(orders, new, ["o_orderkey"])


@query
def insert_new(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = orders.select((F.col("o_orderkey") * 2).alias("o_orderkey"), F.lit(0.0).alias("o_totalprice"), F.lit("X").alias("o_orderstatus"))
    return exchange.inserted(orders, new, ["o_orderkey"])


@query
def rating_errors(spark, sf):
    rows = adapters.frame_ratings(spark, sf)
    faulty = F.when(F.col("task_uuid") % 11 == 0, "Boredom").otherwise(F.col("category"))
    value = F.when(F.col("task_uuid") % 13 == 0, 9).otherwise(F.col("intensity"))
    return rows.select("task_uuid", C.frame_rating_error(faulty, value).alias("error"))


@query
def clip_rating_errors(spark, sf):
    rows = adapters.clip_ratings(spark, sf)
    points = F.when(F.col("task_uuid") % 7 == 0, F.slice("curve", 1, 15)).when(F.col("task_uuid") % 11 == 0, F.concat(F.slice("curve", 1, 15), F.array(F.lit(7.0)))).otherwise(F.col("curve"))
    return rows.select("task_uuid", "annotator_code", C.clip_rating_error(F.col("category"), points).alias("error"))


@query
def duration_clamp(spark, sf):
    ms = F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_totalprice") * 1000 - 50_000_000).cast("bigint"))
    return load(spark, sf, "orders").select("o_orderkey", C.duration(ms).alias("duration_ms"))


@query
def class_count_errors(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("label"))
    expected = rows.distinct().select("label", F.lit(3000).cast("bigint").alias("expected"))
    return design.class_count_errors(rows, expected)


@query
def split_first(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("video_name"), F.col("l_linenumber").alias("label"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ordinal"))
    return files.load_split(rows.groupBy("video_name", "ordinal").agg(F.max("label").alias("label")), "ordinal")


@query
def excluded_duplicates(spark, sf):
    train = load(spark, sf, "customer").select(F.col("c_custkey").alias("clip_id"))
    orders = load(spark, sf, "orders")
    near = orders.select(F.when(F.col("o_orderkey") % 3 == 0, "very_high_similarity").when(F.col("o_orderkey") % 3 == 1, "high_similarity").otherwise("very_high").alias("review_tier"), F.when(F.col("o_orderkey") % 7 == 0, "train").otherwise("test").alias("split_1"), F.col("o_custkey").alias("clip_id_1"), F.when(F.col("o_orderkey") % 11 == 0, "train").otherwise("test").alias("split_2"), (F.col("o_custkey") + 1).alias("clip_id_2"))
    return design.excluded_duplicates(train, near)


@query
def stimulus_audit(spark, sf):
    clips = load(spark, sf, "orders").select(F.col("o_orderkey").alias("clip_id"))
    stimulus = load(spark, sf, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber")).alias("clip_id"))
    return files.stimulus_audit(stimulus, clips)


@query
def missing_clips(spark, sf):
    frames = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("clip_id"), (F.col("l_partkey") % (F.col("l_suppkey") % 3 + 15) + 1).alias("frame_index"))
    wanted = load(spark, sf, "supplier").select((F.col("s_suppkey") + 2).alias("clip_id"))
    return integrity.missing_clips(wanted, frames)


QUERIES |= study.QUERIES
SQL |= study_sql.SQL
