"""Integrity: declared constraints and the checks of a whole study, as tables of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from . import order as order_of
from .agreement import disagreements


def _rows(df: DataFrame, check: str, subject: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(check).alias("check"), subject.cast("string").alias("subject"), (detail.cast("string") if detail is not None else F.lit(None).cast("string")).alias("detail"))


def in_domain(df: DataFrame, check: str, subject: str, column: str, values: list) -> DataFrame:
    return _rows(df.where(~F.col(column).isin(values)), check, F.col(subject), F.col(column))


def in_range(df: DataFrame, check: str, subject: str, column: str, low: float, high: float) -> DataFrame:
    return _rows(df.where(~F.col(column).between(low, high)), check, F.col(subject), F.col(column))


def unique(df: DataFrame, check: str, *columns: str) -> DataFrame:
    many = df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    return _rows(many, check, F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), F.col("n"))


def references(df: DataFrame, check: str, subject: str, column: str, other: DataFrame, key: str) -> DataFrame:
    lost = df.where(F.col(column).isNotNull()).join(other.select(F.col(key).alias(column)), column, "left_anti")
    return _rows(lost, check, F.col(subject), F.col(column))


def _checked(df: DataFrame, subject: str, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """The rows that fail checks (name, condition, detail), one for each failure, in one pass."""
    failed = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(name).alias("check"), detail.cast("string").alias("detail"))) for name, bad, detail in checks]))
    return df.select(F.col(subject).cast("string").alias("subject"), F.explode(failed).alias("f")).select("f.check", "subject", "f.detail")


def _rules(name: str) -> list[tuple[str, Column, Column]]:
    """The checks of a table's single rows that its declaration makes."""
    outside = lambda c, values: (f"{name}.{c}", ~F.col(c).isin(values), F.col(c))
    beyond = lambda c, low, high: (f"{name}.{c}", ~F.col(c).between(low, high), F.col(c))
    needs_index = (F.col("task_type") == "frame") != F.col("frame_index").isNotNull()
    return {
        "tasks": [outside("task_type", S.TASK_TYPES), outside("split", S.SPLITS), outside("repeat_kind", S.REPEAT_KINDS), beyond("frame_index", 1, S.CURVE_POINTS), ("tasks.frame_needs_index", needs_index, F.col("task_type"))],
        "assignments": [outside("role", S.ROLES), outside("status", S.STATUSES)],
        "annotators": [outside("active", [0, 1])],
        "frame_ratings": [outside("visible_category", S.CATEGORIES), beyond("intensity", 0, S.LARGEST_INTENSITY)],
        "clip_ratings": [outside("dominant_category", S.CATEGORIES), *[outside(c, [0, 1]) for c in ("occlusion", "speaking", "abrupt_change", "subject_switch")]],
        "adjudication_cases": [outside("status", ["pending", "complete"])],
    }.get(name, [])


def constraint_violations(study: dict[str, DataFrame]) -> DataFrame:
    """Rows (check, subject, detail) for all that the declared tables forbid: a pass over each table for the checks of its
    rows, an aggregate for each key, a join for each reference."""
    out = []
    for name, df in study.items():
        key = S.PRIMARY_KEYS[name]
        out.append(unique(df, f"{name}.primary_key", *key))
        needed = [f.name for f in S.schema(name).fields if not f.nullable and f.name in df.columns]
        missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needed]))
        out.append(_checked(df, key[0], [(f"{name}.not_null", F.size(missing) > 0, F.array_join(missing, ",")), *_rules(name)]))
    t, a = study["tasks"], study["assignments"]
    out += [
        references(t, "tasks.source_task_uuid", "task_uuid", "source_task_uuid", t, "task_uuid"),
        references(a, "assignments.task_uuid", "assignment_uuid", "task_uuid", t, "task_uuid"), references(a, "assignments.annotator_code", "assignment_uuid", "annotator_code", study["annotators"], "code"),
        unique(a, "assignments.unique", "task_uuid", "annotator_code", "role"),
    ]
    out += [references(study[r], f"{r}.assignment_uuid", "assignment_uuid", "assignment_uuid", a, "assignment_uuid") for r in ("frame_ratings", "clip_ratings", "drafts")]
    return reduce(DataFrame.unionAll, out)


def gap_violations(rows: DataFrame, rater: str, clip: str, order: list[str], gap: int, first_only: bool = True, block: int = order_of.BLOCK) -> DataFrame:
    """Items whose clip came up at most gap places before in the rater's order; the first of each rater, or all.

    A queue of any length is looked at in blocks of places, each with the gap places before it.
    """
    return gap_violations_of_placed(order_of.ranked(rows, [rater], order, "position"), rater, clip, gap, first_only, block)


def gap_violations_of_placed(rows: DataFrame, rater: str, clip: str, gap: int, first_only: bool = True, block: int = order_of.BLOCK) -> DataFrame:
    """gap_violations() of rows whose column position holds their places; rows without a place are not looked at."""
    placed = order_of.with_neighbours(rows, "position", gap, block)
    before = F.lag("position").over(Window.partitionBy(rater, "_block", clip).orderBy("position"))
    near = placed.withColumn("previous", before).where(F.col("_own") & (F.col("position") - F.col("previous") <= gap)).drop("_block", "_own")
    if not first_only:
        return near
    return near.groupBy(rater).agg(F.min_by(F.struct(*near.columns), "position").alias("first")).select("first.*")


def study_violations(study: dict[str, DataFrame], test_clips: int, gap: int, require_complete: bool = False) -> DataFrame:
    """What is wrong with a study: rows (check, subject, detail)."""
    t, a = study["tasks"], study["assignments"]
    base = t.where("task_type = 'frame' AND split = 'test' AND repeat_kind = 'none'").agg(F.count("*").alias("n")).where(F.col("n") != test_clips * S.CURVE_POINTS)
    out = [_rows(base, "base_frame_tasks", F.lit("tasks"), F.col("n"))]
    frames = a.join(t.where("task_type = 'frame' AND split = 'test'").select("task_uuid", "clip_id"), "task_uuid")
    out.append(_rows(gap_violations(frames, "annotator_code", "clip_id", ["queue_position", "assignment_uuid"], gap), "clip_gap", F.col("annotator_code"), F.col("clip_id")))
    whole = lambda p: F.when(p >= 0, F.floor(p)).otherwise(F.ceil(p)).cast("int")  # towards zero
    points = F.transform(F.col("intensities").cast("array<string>"), lambda p: whole(p.try_cast("double")))
    bad = F.col("intensities").isNull() | (F.size("intensities") != S.CURVE_POINTS) | ~F.forall(points, lambda p: p.isNotNull() & p.between(0, S.LARGEST_INTENSITY))
    out.append(_rows(study["clip_ratings"].where(bad), "curve", F.col("assignment_uuid")))
    if require_complete:
        left = a.agg(F.count_if(F.col("status") != "complete").alias("n")).where("n > 0")
        out.append(_rows(left, "incomplete", F.lit("assignments"), F.col("n")))
        rated = a.join(t.where("task_type = 'clip' AND split <> 'calibration'").select("task_uuid"), "task_uuid").join(study["clip_ratings"], "assignment_uuid")
        rated = rated.select("task_uuid", "annotator_code", "role", F.col("dominant_category").alias("category"), F.col("intensities").alias("curve"))
        settled = rated.where("role = 'adjudication'").select("task_uuid")
        unsettled = disagreements(rated).where("needed").join(settled, "task_uuid", "left_anti")
        out.append(_rows(unsettled, "unresolved_disagreement", F.col("task_uuid"), F.array_join("reasons", "|")))
    return reduce(DataFrame.unionAll, out)


def missing_clips(wanted: DataFrame, frames: DataFrame) -> DataFrame:
    """Clips of a rater's tasks that do not have all frames."""
    whole = frames.groupBy("clip_id").agg(F.count_distinct("frame_index").alias("n")).where(F.col("n") == S.CURVE_POINTS)
    return wanted.select("clip_id").distinct().join(whole, "clip_id", "left_anti")


def targets(assigned: DataFrame, *keys: str) -> DataFrame:
    """The different images that raters see: rows (keys, clip_id, frame_index), a clip's task standing for its first frame."""
    return assigned.select(*keys, "clip_id", F.coalesce("frame_index", F.lit(1)).alias("frame_index")).distinct()


def missing_targets(assigned: DataFrame, frames: DataFrame) -> DataFrame:
    """The clips among the targets that do not have all frames."""
    return missing_clips(targets(assigned), frames)
