"""Study tables made from the driver's tables, by the same formulas as in the SQL beside each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CATEGORIES


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments with their tasks: order lines are assignments, suppliers raters, orders tasks."""
    lines = load(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "complete").when(F.col("l_returnflag") == "N", "started").otherwise("pending")
    work = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("assignment_uuid"),
        F.col("l_orderkey").alias("task_uuid"), F.col("l_suppkey").alias("annotator_code"), F.col("l_linenumber").alias("queue_position"),
        status.alias("status"), F.col("l_extendedprice").alias("duration_ms"), F.col("l_partkey").alias("part"),
    )
    tasks = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_uuid"), F.col("o_orderpriority").alias("task_type"), F.col("o_orderstatus").alias("split"))
    return work.join(tasks, "task_uuid")


def clip_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three raters' curves and categories of each vector: rows (task_uuid, annotator_code, role, category, curve)."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("task_uuid"), "label", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    point = "cast(least(6, greatest(0, round(2 + label % 5 - abs(i - (task_uuid + case when e[47 + k] > 0.1 then 5 else 0 end) % 16) * (0.5 * (1 + task_uuid % 3)) + 6 * e[16 * k + i]))) as int)"
    rows = rows.withColumn("curve", F.expr(f"transform(sequence(0, 15), i -> cast({point} as double))"))
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.expr("cast((label + case when e[47 + k] > 0.15 then 1 else 0 end) % 10 + 1 as int)"))
    return rows.select("task_uuid", F.concat(F.lit("R0"), F.col("k").cast("string")).alias("annotator_code"), F.lit("primary").alias("role"), category.alias("category"), "curve")


def two_and_adjudicator(ratings: DataFrame) -> DataFrame:
    """The third rater as adjudicator."""
    return ratings.withColumn("role", F.when(F.col("annotator_code") == "R03", "adjudication").otherwise(F.col("role")))


def frame_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frame ratings: of a user and type, the first is primary and each later one repeats it."""
    rows = load(spark, sf_dir, "events")
    first = rows.groupBy("user_id", "event_type").agg(F.min("event_id").alias("base"))
    rows = rows.join(first, ["user_id", "event_type"])
    kind = F.when(F.col("event_id") == F.col("base"), "none").when(F.col("event_id") % 2 == 0, "second_rater").otherwise("within_rater")
    return rows.select(F.col("event_id").alias("task_uuid"), F.when(F.col("event_id") != F.col("base"), F.col("base")).alias("source_task_uuid"), kind.alias("repeat_kind"), F.concat(F.lit("R"), F.col("event_id") % 4).alias("annotator_code"), F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("event_id") % 10 + 1).cast("int")).alias("category"), F.floor(F.abs("value") % 7).cast("int").alias("intensity"), F.col("user_id").alias("clip_id"), F.col("event_type").alias("frame"))
