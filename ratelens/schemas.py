"""Tables of a rating study: schemas, value sets and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Fixed values of the data model.
EMOTIONS = ["Happiness", "Sadness", "Neutral", "Anger", "Surprise", "Disgust", "Fear"]
CATEGORIES = [*EMOTIONS, "Mixed", "Unclear", "Face not visible"]
NO_CONSENSUS = "No consensus"
TASK_TYPES = ["frame", "clip"]
SPLITS = ["test", "train_alignment", "calibration"]
REPEAT_KINDS = ["none", "second_rater", "within_rater"]
ROLES = ["primary", "second", "hidden_repeat", "adjudication"]
STATUSES = ["pending", "started", "complete", "skipped"]
CURVE_POINTS = 16
LARGEST_INTENSITY = 6
DAY_MS = 86_400_000


#: The columns of each table, as DDL.
TABLES: dict[str, str] = {
    "study_meta": "key string NOT NULL, value string NOT NULL",
    "annotators": "code string NOT NULL, display_name string NOT NULL, active int NOT NULL, created_at timestamp NOT NULL",
    "tasks": "task_uuid string NOT NULL, task_type string NOT NULL, split string NOT NULL, clip_id int NOT NULL, frame_index int, source_task_uuid string, repeat_kind string NOT NULL, created_at timestamp NOT NULL",
    "assignments": "assignment_uuid string NOT NULL, task_uuid string NOT NULL, annotator_code string NOT NULL, role string NOT NULL, queue_position int NOT NULL, status string NOT NULL, started_at timestamp, completed_at timestamp, duration_ms bigint",
    "frame_ratings": "assignment_uuid string NOT NULL, visible_category string NOT NULL, intensity int NOT NULL, submitted_at timestamp NOT NULL",
    "clip_ratings": "assignment_uuid string NOT NULL, dominant_category string NOT NULL, intensities array<double> NOT NULL, occlusion int NOT NULL, speaking int NOT NULL, abrupt_change int NOT NULL, subject_switch int NOT NULL, submitted_at timestamp NOT NULL",
    "drafts": "assignment_uuid string NOT NULL, payload_json string NOT NULL, updated_at timestamp NOT NULL",
    "import_log": "bundle_id string NOT NULL, imported_at timestamp NOT NULL, source_path string NOT NULL, rows_imported int NOT NULL",
    "adjudication_cases": "task_uuid string NOT NULL, reasons array<string> NOT NULL, status string NOT NULL, created_at timestamp NOT NULL",
}

PRIMARY_KEYS = {
    "study_meta": ["key"], "annotators": ["code"], "tasks": ["task_uuid"], "assignments": ["assignment_uuid"],
    "frame_ratings": ["assignment_uuid"], "clip_ratings": ["assignment_uuid"], "drafts": ["assignment_uuid"],
    "import_log": ["bundle_id"], "adjudication_cases": ["task_uuid"],
}


def schema(name: str) -> T.StructType:
    """The schema of a table (needs a session)."""
    return T.StructType.fromDDL(TABLES[name])


def empty_study(spark: SparkSession) -> dict[str, DataFrame]:
    """All tables of a new study, without rows."""
    return {name: spark.createDataFrame([], schema(name)) for name in TABLES}
