"""Agreement of raters: disagreement, adjudication, consensus, reliability and calibration reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.trajectory import DESCRIPTORS, with_descriptors
from ..schemas import NO_CONSENSUS

#: Differences that call for a third rating: of intensity at any point, and of apex positions.
INTENSITY_GAP, PEAK_GAP = 3.0, 4


def curves_gap(a: Column, b: Column) -> Column:
    """The largest difference of two curves."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def disagreements(ratings: DataFrame, key: str = "task_uuid") -> DataFrame:
    """Rows (key, needed, reasons) of tasks with exactly two base ratings.

    ratings: rows (key, annotator_code, role, category, curve). Ratings of the role adjudication are no base ratings.
    Reasons stand in a fixed order; a curve that is not 16 points long ends the comparison.
    """
    base = ratings.where("role <> 'adjudication'").select(key, "annotator_code", "category", "curve")
    described = with_descriptors(base, "curve", "category").select(key, F.struct("annotator_code", "category", "curve", "curve_error", "apex_position", "peak_type").alias("r"))
    pairs = described.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rs")).where(F.size("rs") == 2)
    a, b = F.col("rs")[0], F.col("rs")[1]
    malformed = (F.coalesce(F.size(a.curve), F.lit(0)) != 16) | (F.coalesce(F.size(b.curve), F.lit(0)) != 16)
    reasons = F.array_compact(
        F.array(
            F.when(~a.category.eqNullSafe(b.category), F.lit("category")),
            F.when(malformed, F.lit("invalid_curve")),
            F.when(~malformed & (curves_gap(a.curve, b.curve) >= INTENSITY_GAP), F.lit("intensity_gap")),
            F.when(~malformed & (F.abs(a.apex_position - b.apex_position) >= PEAK_GAP), F.lit("peak_gap")),
            F.when(~malformed & ~a.peak_type.eqNullSafe(b.peak_type), F.lit("peak_type")),
        )
    )
    return pairs.select(key, reasons.alias("reasons")).select(key, (F.size("reasons") > 0).alias("needed"), "reasons")


def consensus_category(categories: Column) -> Column:
    """The category that at least two ratings and more than any other name, else no consensus."""
    counts = F.transform(F.array_distinct(categories), lambda c: F.struct(F.size(F.filter(categories, lambda x: x == c)).alias("n"), c.alias("c")))
    ordered = F.sort_array(counts, asc=False)
    unique = (ordered[0].n >= 2) & (F.coalesce(F.get(ordered, F.lit(1)).n, F.lit(0)) < ordered[0].n)
    return F.when(F.coalesce(unique, F.lit(False)), ordered[0].c).otherwise(F.lit(NO_CONSENSUS))


def combined_curve(curves: Column, n: Column) -> Column:
    """Point by point the median of three curves, else the mean."""
    at = lambda i: F.transform(curves, lambda c: F.get(c, F.lit(i)))
    middle = lambda i: F.when(F.forall(at(i), lambda x: x.isNotNull()), F.get(F.sort_array(at(i)), F.lit(1)))
    mean = lambda i: F.aggregate(at(i), F.lit(0.0), lambda s, x: s + x) / n
    return F.when(n == 3, F.array(*[middle(i) for i in range(16)])).otherwise(F.array(*[mean(i) for i in range(16)]))


def consensus(ratings: DataFrame, key: str = "task_uuid", carry: tuple[str, ...] = ()) -> DataFrame:
    """The agreed curve and category of each task, with descriptors, reasons, and whether it was adjudicated.

    A task needs two base ratings; where two disagree, it also needs an adjudication (the first by rater's code).
    """
    item = F.struct(F.col("annotator_code").alias("code"), F.col("category"), F.col("curve").cast("array<double>").alias("curve"))
    own = ratings.groupBy(key, *carry).agg(
        F.array_sort(F.collect_list(F.when(F.col("role") != "adjudication", item))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "adjudication", item))).alias("third"),
    )
    rows = own.join(disagreements(ratings, key), key, "left").withColumn("needed", F.coalesce("needed", F.lit(False)))
    rows = rows.where((F.size("base") >= 2) & (~F.col("needed") | (F.size("third") > 0)))
    rows = rows.withColumn("used", F.concat("base", F.slice("third", 1, 1))).withColumn("n_ratings", F.size("used"))
    rows = rows.withColumn("category", consensus_category(F.transform("used", lambda r: r.category))).withColumn("curve", combined_curve(F.transform("used", lambda r: r.curve), F.col("n_ratings")))
    return with_descriptors(rows, "curve", "category").drop("base", "used")


def adjudication_records(agreed: DataFrame, key: str = "task_uuid") -> DataFrame:
    """What third ratings decided: one row for each agreed task that needed one."""
    third = F.get(F.col("third"), F.lit(0))
    return agreed.where("needed").select(key, F.array_join("reasons", "|").alias("reasons"), third.code.alias("third_annotator"), third.category.alias("third_category"), third.curve.alias("third_curve"), F.col("category").alias("final_category"), F.col("curve").alias("final_curve"), F.lit("complete").alias("status"))


def _json_list(values: Column) -> Column:
    """A list of numbers as JSON text."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: x.cast("string")), ", "), F.lit("]"))


def consensus_table(agreed: DataFrame) -> DataFrame:
    """The exported consensus: a row for each clip with its category, its curve (as text and point by point) and descriptors.

    agreed: consensus() with the columns clip_id and split carried along.
    """
    rounded = F.transform("curve", lambda x: F.bround(x, 6))
    scalars = [d for d in DESCRIPTORS if d != "adjacent_differences"]
    return agreed.select("clip_id", "split", "n_ratings", F.col("category").alias("dominant_category"), _json_list(rounded).alias("intensities_json"), *C.wide_curve(F.col("curve")), *scalars, _json_list(F.transform("adjacent_differences", lambda x: F.bround(x, 6))).alias("adjacent_differences_json"))


def adjudication_table(agreed: DataFrame) -> DataFrame:
    """The exported adjudications: what third ratings said and what came of them."""
    third = F.get(F.col("third"), F.lit(0))
    said = F.transform(third.curve, lambda x: F.when(x == F.floor(x), x.cast("int").cast("string")).otherwise(x.cast("string")))
    return agreed.where("needed").select("clip_id", "split", F.array_join("reasons", "|").alias("reasons"), third.code.alias("third_annotator"), third.category.alias("third_category"), _json_list(said).alias("third_intensities_json"), F.col("category").alias("final_category"), _json_list(F.transform("curve", lambda x: F.bround(x, 6))).alias("final_intensities_json"), F.lit("complete").alias("status"))


def raw_frames(rows: DataFrame) -> DataFrame:
    """The exported frame ratings, calibration and repeats included: rows of tasks, assignments and ratings joined."""
    return rows.select("task_uuid", "source_task_uuid", "annotator_code", "role", "duration_ms", "clip_id", "frame", "repeat_kind", F.col("category").alias("visible_category"), "intensity", "submitted_at")


def raw_clips(assignments: DataFrame, tasks: DataFrame, ratings: DataFrame) -> DataFrame:
    """The exported clip ratings, calibration and adjudications included, with their curves as text and point by point."""
    rows = assignments.join(tasks.select("task_uuid", "clip_id", "split"), "task_uuid").join(ratings, "assignment_uuid")
    whole = F.transform("intensities", lambda x: x.cast("int"))
    return rows.select("annotator_code", "role", "duration_ms", "clip_id", "split", "dominant_category", _json_list(F.transform(whole, lambda x: x.cast("string"))).alias("intensities_json"), "occlusion", "speaking", "abrupt_change", "subject_switch", "submitted_at", *C.wide_curve(whole))


def new_adjudications(ratings: DataFrame, tasks: DataFrame, annotators: DataFrame, assignments: DataFrame) -> DataFrame:
    """Third ratings that are needed: rows (task_uuid, reasons, annotator_code, assignment_uuid, role, queue_position, problem, assigned).

    Clip tasks outside calibration whose two base ratings disagree. assigned says that the rater has the adjudication
    already (its case is refreshed, nothing is added, queue_position is null). Where there is not exactly one other active
    rater, the problem says so and no rater is named. New cases of a rater follow the rater's queue.
    """
    wanted = tasks.where("task_type = 'clip' AND split <> 'calibration'").select("task_uuid")
    own = ratings.join(wanted, "task_uuid", "left_semi")
    raters = own.where("role <> 'adjudication'").groupBy("task_uuid").agg(F.collect_set("annotator_code").alias("had"))
    active = annotators.where("active = 1").agg(F.collect_set("code").alias("codes"))  # one row
    rows = disagreements(own).where("needed").join(raters, "task_uuid").crossJoin(F.broadcast(active)).withColumn("_free", F.array_except("codes", "had"))
    rows = rows.withColumn("annotator_code", F.when(F.size("_free") == 1, F.col("_free")[0])).withColumn("problem", F.when(F.size("_free") != 1, F.lit("no unique third rater")))
    there = assignments.where("role = 'adjudication'").select("task_uuid", "annotator_code", F.lit(True).alias("assigned")).distinct()
    rows = rows.join(there, ["task_uuid", "annotator_code"], "left").withColumn("assigned", F.coalesce("assigned", F.lit(False)))
    last = assignments.groupBy("annotator_code").agg(F.max("queue_position").alias("_last"))
    by = Window.partitionBy("annotator_code", "assigned").orderBy("task_uuid")
    rows = rows.join(last, "annotator_code", "left").withColumn("queue_position", F.when(F.col("annotator_code").isNotNull() & ~F.col("assigned"), F.coalesce("_last", F.lit(0)) + F.row_number().over(by)))
    return rows.select("task_uuid", "reasons", "annotator_code", F.when(F.col("annotator_code").isNotNull(), C.stable_uuid("assignment", F.col("task_uuid"), F.col("annotator_code"), "adjudication")).alias("assignment_uuid"), F.lit("adjudication").alias("role"), "queue_position", "problem", "assigned")


def refreshed_cases(cases: DataFrame, found: DataFrame) -> DataFrame:
    """The adjudication cases after a scan: found ones get their reasons anew and keep their status (pending if new)."""
    known = cases.select("task_uuid", F.col("status").alias("_status"))
    new = found.where("problem IS NULL").select("task_uuid", "reasons").join(known, "task_uuid", "left")
    new = new.select("task_uuid", "reasons", F.coalesce("_status", F.lit("pending")).alias("status"), F.current_timestamp().alias("created_at"))
    return cases.join(new.select("task_uuid"), "task_uuid", "left_anti").unionByName(new, allowMissingColumns=True)


def reliability_pairs(frames: DataFrame, keys: tuple[str, ...] = ("clip_id", "frame")) -> DataFrame:
    """Each repeated frame rating beside its primary one; repeats without a primary rating are left out.

    frames: rows (task_uuid, source_task_uuid, repeat_kind, annotator_code, category, intensity) and the keys.
    """
    base = frames.where("repeat_kind = 'none'").select(F.col("task_uuid").alias("source_task_uuid"), F.col("annotator_code").alias("primary_annotator"), F.col("category").alias("primary_category"), F.col("intensity").cast("double").alias("primary_intensity"))
    repeat = frames.where("repeat_kind IN ('second_rater', 'within_rater')").select(*keys, "source_task_uuid", "repeat_kind", F.col("annotator_code").alias("repeat_annotator"), F.col("category").alias("repeat_category"), F.col("intensity").cast("double").alias("repeat_intensity"))
    both = repeat.join(base, "source_task_uuid")
    return both.select(*keys, "repeat_kind", "primary_annotator", "repeat_annotator", "primary_category", "repeat_category", (F.col("primary_category") == F.col("repeat_category")).cast("int").alias("category_agreement"), "primary_intensity", "repeat_intensity", F.abs(F.col("primary_intensity") - F.col("repeat_intensity")).alias("absolute_intensity_gap"))


def primary_duplicates(frames: DataFrame, keys: tuple[str, ...] = ("clip_id", "frame")) -> DataFrame:
    """Frames with more than one primary rating."""
    return frames.where("repeat_kind = 'none'").groupBy(*keys).agg(F.count("*").alias("primaries")).where("primaries > 1")


def calibration_report(ratings: DataFrame, key: str = "task_uuid", expected: int = 3) -> DataFrame:
    """Rows (key, n_completed, category_unanimous, categories, mean_pairwise_intensity_gap) of calibration tasks.

    ratings: rows (key, annotator_code, category, curve), a frame's curve being its one intensity. Categories stand in
    the order of raters' codes; the gap is the mean over pairs of raters of the mean difference over points.
    """
    own = ratings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("annotator_code", "category", F.col("curve").cast("array<double>").alias("curve")))).alias("rs"))
    n = F.size("rs")
    distance = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    pairs = F.flatten(F.transform("rs", lambda a, i: F.transform(F.slice(F.col("rs"), i + 2, n), lambda b: distance(a.curve, b.curve))))
    gap = F.aggregate("pairs", F.lit(0.0), lambda s, x: s + x) / F.size("pairs")
    categories = F.transform("rs", lambda r: r.category)
    rows = own.withColumn("pairs", F.when(n >= 2, pairs))
    return rows.select(key, n.alias("n_completed"), ((n == expected) & (F.size(F.array_distinct(categories)) == 1)).cast("int").alias("category_unanimous"), F.array_join(categories, "|").alias("categories"), gap.alias("mean_pairwise_intensity_gap"))


def calibration_summary(report: DataFrame, expected: int = 3) -> DataFrame:
    """Unanimity and mean gap over tasks with all ratings."""
    done = report.where(F.col("n_completed") == expected)
    return done.agg(F.count("*").alias("completed"), F.avg("category_unanimous").alias("unanimity"), F.avg("mean_pairwise_intensity_gap").alias("mean_gap"))
