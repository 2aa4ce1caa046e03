"""Streams of drafts and events (an extension: studies keep these in tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.exchange import latest


def stored_drafts(drafts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's newest draft of every assignment under the folder; current_drafts() reads the result.

    A batch that runs again writes the same folder again, so a restart repeats nothing.
    """

    def store(batch: DataFrame, number: int) -> None:
        latest(batch, ["assignment_uuid"], "updated_at").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return drafts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_drafts(stored: DataFrame) -> DataFrame:
    return latest(stored, ["assignment_uuid"], "updated_at")


def activity_per_window(events: DataFrame, at: str = "ts", key: str = "annotator_code", length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events of each rater by time window, complete once the watermark has passed."""
    return events.withWatermark(at, late).groupBy(F.window(at, length), key).agg(F.count("*").alias("events"))
