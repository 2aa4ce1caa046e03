"""Progress of raters: next tasks, counts, gates, workload and active time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import order as order_of


def with_tasks(assignments: DataFrame, tasks: DataFrame, *columns: str) -> DataFrame:
    """Assignments with columns of their tasks (assignments without a task are left out)."""
    return assignments.join(tasks.select("task_uuid", *columns), "task_uuid")


def status_counts(assigned: DataFrame, *keys: str) -> DataFrame:
    """Total, complete and started assignments by key."""
    count = lambda status: F.count_if(F.col("status") == status)
    return assigned.groupBy(*keys).agg(F.count("*").alias("total"), count("complete").alias("complete"), count("started").alias("started"))


def next_task(assigned: DataFrame, key: str = "annotator_code", order: tuple[str, ...] = ("queue_position", "assignment_uuid")) -> DataFrame:
    """For each rater the open assignment that comes next: started ones first, then by queue."""
    by = Window.partitionBy(key).orderBy((F.col("status") != "started").cast("int"), *order)
    return assigned.where("status <> 'complete'").withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def completion_gate(counts: DataFrame, *keys: str) -> DataFrame:
    """Whether all counted groups of a key are complete; a key without any group has no row."""
    return counts.groupBy(*keys).agg(F.bool_and(F.col("complete") == F.col("total")).alias("all_complete"))


def workload(assigned: DataFrame, rater: str = "annotator_code", kind: str = "task_type", split: str = "split") -> DataFrame:
    """Done and remaining work of each rater, kind and split, with the hours that remain at the median pace.

    The pace is the rater's exact median over positive durations of complete work of the kind, else that of all raters.
    """
    done = assigned.where("status = 'complete' AND duration_ms > 0")
    whose = F.explode(F.array(F.struct(F.lit(False).alias("_pooled"), F.col(rater).alias("_who")), F.struct(F.lit(True).alias("_pooled"), F.lit(None).alias("_who"))))
    each = done.select(whose.alias("_g"), kind, "duration_ms").groupBy("_g._pooled", "_g._who", kind, "duration_ms").agg(F.count("*").alias("n"))
    middle = order_of.exact_medians(each, ["_pooled", "_who", kind], "duration_ms", "n", "_median")  # of each rater and of all, in one pass
    own = middle.where("NOT _pooled").select(F.col("_who").alias(rater), kind, F.col("_median").alias("own"))
    pooled = middle.where("_pooled").select(kind, F.col("_median").alias("pooled"))
    counts = assigned.groupBy(rater, kind, split).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "complete").alias("completed"))
    pace = F.coalesce("own", "pooled")
    left = F.col("total") - F.col("completed")
    out = counts.join(own, [rater, kind], "left").join(pooled, [kind], "left")
    return out.select(rater, kind, split, "total", "completed", left.alias("remaining"), (pace / 1000).alias("median_completed_seconds"), (left * pace / 3.6e6).alias("estimated_remaining_hours"))


def logged_in(annotators: DataFrame, entered: DataFrame, text: str = "text") -> DataFrame:
    """Entered codes that belong to an active rater, blanks and case aside: the rows of entered with the rater's code."""
    active = annotators.where("active = 1").select("code")
    return entered.withColumn("code", C.login_code(F.col(text))).join(active, "code", "left_semi")


def active_time(events: DataFrame, key: str, at_ms: Column, visible: Column, cap_ms: int = 60_000, order: tuple[str, ...] = (), block: int = order_of.BLOCK) -> DataFrame:
    """Milliseconds of activity: gaps between events up to a cap, counted while the page was visible before the event."""
    rows = events.select(key, at_ms.alias("_when"), visible.alias("_visible"), *order)
    rows = order_of.with_neighbours(order_of.ranked(rows, [key], ["_when", *order, "_visible"], "_place"), "_place", 1, block)
    by = Window.partitionBy(key, "_block").orderBy("_place")
    gap = F.least(F.col("_when") - F.lag("_when").over(by), F.lit(cap_ms))
    rows = rows.withColumn("_gap", F.when(F.lag("_visible").over(by), gap)).where("_own")
    return rows.groupBy(key).agg(F.coalesce(F.sum("_gap"), F.lit(0)).cast("bigint").alias("active_ms"))


def probes(assigned: DataFrame, key: str, *order: str) -> DataFrame:
    """The first, middle and last task of each key's list."""
    rows = order_of.ranked(assigned, [key], list(order), "_n", "_size")
    return rows.where("_n IN (1, _size div 2 + 1, _size)").drop("_n", "_size")


def owned_task(assigned: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The wanted rows (of a rater and task or medium) that an assignment allows."""
    return wanted.join(assigned.select(*keys), list(keys), "left_semi")
