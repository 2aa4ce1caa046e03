"""What raters' events make of assignments: their status, rating, draft and active time.

An event is a row (event_id, assignment_uuid, kind, at, visible, payload_json, visible_category, intensity, duration_ms).
Its kind is opened, draft, submitted, reset or any other activity; visible says whether the page is seen from then on.
Events are ordered by time and id. A reset makes all before it count for nothing. After it, the first opening starts the
assignment, each valid submission completes it and removes the draft so far, the newest one's rating stands, and the newest
draft after it is kept. What stands depends on the set of events only, so they may arrive in any order and repeatedly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .progress import active_time

EVENTS = "event_id string, assignment_uuid string, kind string, at timestamp, visible boolean, payload_json string, visible_category string, intensity int, duration_ms bigint"
STATES = "assignment_uuid string, status string, started_at timestamp, completed_at timestamp, duration_ms bigint, visible_category string, intensity int, payload_json string, rejected bigint, active_ms bigint"


def once(events: DataFrame) -> DataFrame:
    """Each event once, by its id."""
    return events.dropDuplicates(["event_id"])


def assignment_states(events: DataFrame) -> DataFrame:
    """One row (STATES) for each assignment that has events, by aggregates that are combined before they are shuffled."""
    events = once(events).withColumn("_key", F.struct("at", "event_id"))
    resets = events.where("kind = 'reset'").groupBy("assignment_uuid").agg(F.max("_key").alias("_reset"))
    live = events.join(resets, "assignment_uuid", "left").where(F.col("_reset").isNull() | (F.col("_key") > F.col("_reset")))
    error = C.frame_rating_error(F.col("visible_category"), F.col("intensity"))
    sent = F.col("kind") == "submitted"
    valid = sent & error.isNull()
    rating = F.struct("_key", F.struct("duration_ms", "visible_category", "intensity").alias("rating"))
    parts = live.groupBy("assignment_uuid").agg(
        F.min(F.when(F.col("kind") == "opened", F.col("_key"))).alias("opened"),
        F.min(F.when(valid, F.col("_key"))).alias("first"),
        F.max(F.when(valid, rating)).alias("last"),
        F.max(F.when(F.col("kind") == "draft", F.struct("_key", "payload_json"))).alias("draft"),
        F.count_if(sent & error.isNotNull()).alias("rejected"),
    )
    time = active_time(live, "assignment_uuid", F.unix_millis("at"), F.col("visible"), order=("event_id",))
    out = events.select("assignment_uuid").distinct().join(parts, "assignment_uuid", "left").join(time, "assignment_uuid", "left")
    done, started = F.col("last").isNotNull(), F.col("opened").isNotNull()
    return out.select(
        "assignment_uuid", F.when(done, "complete").when(started, "started").otherwise("pending").alias("status"),
        F.when(F.col("first").isNull() | (F.col("opened") < F.col("first")), F.col("opened.at")).alias("started_at"), F.col("last._key.at").alias("completed_at"),
        C.duration(F.col("last.rating.duration_ms")).alias("duration_ms"), "last.rating.visible_category", "last.rating.intensity",
        F.when(~done | (F.col("draft._key") > F.col("last._key")), F.col("draft.payload_json")).alias("payload_json"),
        F.coalesce("rejected", F.lit(0)).cast("bigint").alias("rejected"), F.coalesce("active_ms", F.lit(0)).cast("bigint").alias("active_ms"),
    )
