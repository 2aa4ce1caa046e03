"""Draft and activity streams over files."""

from pyspark.sql import functions as F

from ratelens.streaming import drafts


def test_newest_draft_survives_batches_and_restarts(spark, tmp_path):
    source, store, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = "assignment_uuid string, payload_json string, updated_at timestamp"

    def arrive(rows):
        spark.createDataFrame(rows, "assignment_uuid string, payload_json string, at string").select("assignment_uuid", "payload_json", F.to_timestamp("at").alias("updated_at")).write.mode("append").parquet(source)

    def run():
        drafts.stored_drafts(spark.readStream.schema(schema).parquet(source), store, marks).awaitTermination()
        return {r.assignment_uuid: r.payload_json for r in drafts.current_drafts(spark.read.parquet(store)).collect()}

    arrive([("a", "old", "2026-01-01 00:00:00"), ("a", "new", "2026-01-01 00:00:05"), ("b", "one", "2026-01-01 00:00:01")])
    assert run() == {"a": "new", "b": "one"}
    arrive([("b", "two", "2026-01-02 00:00:00"), ("a", "late", "2025-12-31 00:00:00")])
    assert run() == {"a": "new", "b": "two"}
    assert run() == {"a": "new", "b": "two"}


def test_activity_windows(spark, tmp_path):
    spark.createDataFrame([("R1", 0), ("R1", 60), ("R2", 700)], "annotator_code string, s int").select("annotator_code", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("annotator_code string, ts timestamp").parquet(str(tmp_path / "in"))
    drafts.activity_per_window(stream).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    rows = spark.table("activity").select("annotator_code", "events").collect()
    assert sorted(map(tuple, rows)) == [("R1", 2), ("R2", 1)]
