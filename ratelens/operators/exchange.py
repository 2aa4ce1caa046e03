"""Exchange of ratings: bundles for raters, exports, idempotent merging, drafts and saved ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import CATEGORIES, LARGEST_INTENSITY

Study = dict[str, DataFrame]
RATINGS = ("frame_ratings", "clip_ratings")
FLAGS = ("occlusion", "speaking", "abrupt_change", "subject_switch")
#: Fixed value: who rates in a practice study.
PRACTICE_RATER = "TEST"


def latest(rows: DataFrame, keys: list[str], *newest: str) -> DataFrame:
    """One row for each key: the newest by the given columns, ties by all other columns (an upsert's result)."""
    rest = [f.name for f in rows.schema.fields if f.name not in (*keys, *newest) and f.dataType.typeName() != "map"]
    by = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in (*newest, *rest)])
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with those rows of new whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def save_ratings(study: Study, kind: str, ratings: DataFrame) -> tuple[Study, DataFrame]:
    """The study after a batch of submitted ratings, and the rejected ones with their errors.

    ratings: the columns of the kind's table (a frame's or clip's) and duration_ms. Valid ones replace earlier ratings,
    complete their assignments and remove their drafts; a complete task may be rated again.
    """
    error = C.frame_rating_error(F.col("visible_category"), F.col("intensity")) if kind == "frame_ratings" else C.clip_rating_error(F.col("dominant_category"), F.col("intensities"))
    known = study["assignments"].select("assignment_uuid", F.lit(True).alias("_known"))
    checked = ratings.join(known, "assignment_uuid", "left").withColumn("error", F.coalesce(F.when(F.col("_known").isNull(), F.lit("assignment")), error)).drop("_known")
    if kind == "clip_ratings":
        checked = checked.withColumns({c: C.flag(F.col(c)) for c in FLAGS if c in checked.columns})
    good = latest(checked.where("error IS NULL"), ["assignment_uuid"], "submitted_at")
    done = good.select("assignment_uuid", F.col("submitted_at").alias("_at"), C.duration(F.col("duration_ms")).alias("_ms"))
    work = study["assignments"].join(done, "assignment_uuid", "left")
    hit = F.col("_at").isNotNull()
    work = work.withColumns({"status": F.when(hit, "complete").otherwise(F.col("status")), "completed_at": F.coalesce("_at", "completed_at"), "duration_ms": F.when(hit, F.col("_ms")).otherwise(F.col("duration_ms"))}).drop("_at", "_ms")
    out = dict(study)
    out[kind] = upserted(study[kind], good.select(*study[kind].columns), ["assignment_uuid"])
    out["assignments"] = work
    out["drafts"] = study["drafts"].join(good.select("assignment_uuid"), "assignment_uuid", "left_anti")
    return out, checked.where("error IS NOT NULL")


def opened(study: Study, events: DataFrame) -> Study:
    """The study after raters opened tasks: pending assignments become started at the first opening."""
    first = events.groupBy("assignment_uuid").agg(F.min("opened_at").alias("_at"))
    work = study["assignments"].join(first, "assignment_uuid", "left")
    now = (F.col("status") == "pending") & F.col("_at").isNotNull()
    return study | {"assignments": work.withColumns({"started_at": F.when(now, F.col("_at")).otherwise(F.col("started_at")), "status": F.when(now, "started").otherwise(F.col("status"))}).drop("_at")}


def save_drafts(study: Study, drafts: DataFrame) -> Study:
    """The study after a batch of drafts: the newest of each assignment is kept, its payload is not checked."""
    return study | {"drafts": upserted(study["drafts"], latest(drafts, ["assignment_uuid"], "updated_at"), ["assignment_uuid"])}


def open_drafts(study: Study) -> DataFrame:
    """Drafts of assignments that are not complete."""
    return study["drafts"].join(study["assignments"].where("status <> 'complete'").select("assignment_uuid"), "assignment_uuid", "left_semi")


def may_reset(study: Study, rater: str) -> bool:
    """Whether a rater's work may be reset: in a practice study only, by its practice rater."""
    return rater == PRACTICE_RATER and not study["study_meta"].where("key = 'practice_mode' AND value = '1'").isEmpty()


def reset_practice(study: Study, rater: str) -> Study:
    """The study with one rater's assignments pending again and without that rater's ratings and drafts (see may_reset)."""
    own = study["assignments"].where(F.col("annotator_code") == rater).select("assignment_uuid")
    out = study | {t: study[t].join(own, "assignment_uuid", "left_anti") for t in (*RATINGS, "drafts")}
    mine = F.col("annotator_code") == rater
    none = {c: F.when(~mine, F.col(c)) for c in ("started_at", "completed_at", "duration_ms")}
    return out | {"assignments": study["assignments"].withColumns(none | {"status": F.when(mine, "pending").otherwise(F.col("status"))})}


def rater_bundle(study: Study, rater: str) -> Study:
    """The study as one rater gets it: all tasks, but only that rater's assignments, ratings and drafts."""
    work = study["assignments"].where(F.col("annotator_code") == rater)
    ids = work.select("assignment_uuid")
    out = study | {"annotators": study["annotators"].where(F.col("code") == rater), "assignments": work}
    out |= {t: study[t].join(ids, "assignment_uuid", "left_semi") for t in (*RATINGS, "drafts")}
    out |= {t: study[t].limit(0) for t in ("import_log", "adjudication_cases")}
    stamp = study["study_meta"].sparkSession.createDataFrame([("bundle_annotator", rater)], "key string, value string")
    return out | {"study_meta": upserted(study["study_meta"], stamp, ["key"])}


def export_results(study: Study, rater: str) -> Study:
    """A rater's complete assignments with their ratings, and one row that describes them."""
    work = study["assignments"].where((F.col("annotator_code") == rater) & (F.col("status") == "complete"))
    ids = work.select("assignment_uuid")
    version = study["study_meta"].where("key = 'design_version'").agg(F.max("value").alias("design_version"))
    # The bundle's id is a digest of all ids of one rater, so this list is as long as that rater's work.
    about = work.agg(F.collect_list("assignment_uuid").alias("ids"), F.count("*").alias("completed_assignments")).crossJoin(F.broadcast(version))  # one row each
    about = about.select(C.bundle_id(F.lit(rater), F.col("ids")).alias("bundle_id"), F.lit(rater).alias("annotator"), "design_version", F.current_timestamp().alias("exported_at"), "completed_assignments")
    return {"bundle": about, "assignments": work} | {t: study[t].join(ids, "assignment_uuid", "left_semi") for t in RATINGS}


def merge_problems(study: Study, bundles: Study) -> DataFrame:
    """Assignments of bundles that the study does not know, or knows with another task or rater."""
    keys = ("task_uuid", "annotator_code")
    known = study["assignments"].select("assignment_uuid", *[F.col(c).alias(f"own_{c}") for c in keys])
    rows = bundles["assignments"].select("assignment_uuid", *keys).join(known, "assignment_uuid", "left")
    differs = F.col("own_task_uuid").isNull()
    for c in keys:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"own_{c}"))
    return rows.where(differs).select("assignment_uuid", F.when(F.col("own_task_uuid").isNull(), "unknown").otherwise("mismatch").alias("problem"))


def rating_problems(study: Study, bundles: Study) -> DataFrame:
    """Ratings of bundles that the study's tables refuse, with why: an unknown assignment, a category or an intensity outside
    the value sets, a missing curve, a flag that is neither 0 nor 1."""
    known = study["assignments"].select("assignment_uuid", F.lit(True).alias("_known"))
    outside = lambda c, values: F.col(c).isNull() | ~F.col(c).isin(values)
    bad_flag = F.lit(False)
    for c in FLAGS:
        bad_flag = bad_flag | outside(c, [0, 1])
    checks = {
        "frame_ratings": [("category", outside("visible_category", CATEGORIES)), ("intensity", F.col("intensity").isNull() | ~F.col("intensity").between(0, LARGEST_INTENSITY))],
        "clip_ratings": [("category", outside("dominant_category", CATEGORIES)), ("curve", F.col("intensities").isNull()), ("flag", bad_flag)],
    }
    out = []
    for kind, rules in checks.items():
        rows = bundles[kind].join(known, "assignment_uuid", "left")
        problem = F.when(F.col("_known").isNull(), "unknown")
        for name, bad in rules:
            problem = problem.when(bad, name)
        out.append(rows.select("assignment_uuid", F.lit(kind).alias("kind"), problem.alias("problem")).where("problem IS NOT NULL"))
    return out[0].unionAll(out[1])


def merged(study: Study, bundles: Study) -> Study:
    """The study with all bundles that it has not imported yet; raises if any assignment or rating does not fit (nothing is
    taken).

    bundles: tables of one or more exports, each row with its bundle_id; bundle has bundle_id, design_version, source_path
    and, where the order of bundles matters, their number: what a later one holds wins. Imported assignments are complete.
    The checks collect a count and the design versions only.
    """
    about = bundles["bundle"] if "number" in bundles["bundle"].columns else bundles["bundle"].withColumn("number", F.lit(0))
    new = about.join(study["import_log"].select("bundle_id"), "bundle_id", "left_anti")
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy("bundle_id").orderBy("number", "source_path"))).where("_n = 1").drop("_n")
    fresh = {t: bundles[t].join(new.select("bundle_id", F.col("number").alias("_number")), "bundle_id") for t in ("assignments", *RATINGS)}
    version = study["study_meta"].where("key = 'design_version'").select("value").first()
    if version and not new.where(~F.col("design_version").eqNullSafe(F.lit(version[0]))).isEmpty():
        raise ValueError("a bundle is of another design version")
    if not merge_problems(study, fresh).isEmpty():
        raise ValueError("a bundle holds assignments that the study does not know")
    if found := rating_problems(study, fresh).take(3):
        raise ValueError(f"a bundle holds ratings that the study refuses: {[tuple(r) for r in found]}")
    times = ("started_at", "completed_at", "duration_ms")
    done = latest(fresh["assignments"], ["assignment_uuid"], "_number").select("assignment_uuid", F.lit("complete").alias("new_status"), *[F.col(c).alias(f"new_{c}") for c in times])
    work = study["assignments"].join(done, "assignment_uuid", "left")
    work = work.withColumns({c: F.when(F.col("new_status").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)) for c in times} | {"status": F.coalesce("new_status", "status")})
    out = study | {"assignments": work.select(*study["assignments"].columns)}
    for t in RATINGS:
        rated = latest(fresh[t], ["assignment_uuid"], "_number", "submitted_at").withColumn("submitted_at", F.coalesce("submitted_at", F.current_timestamp()))
        out[t] = upserted(study[t], rated.select(*study[t].columns), ["assignment_uuid"])
    counts = fresh["assignments"].groupBy("bundle_id").agg(F.count("*").cast("int").alias("rows_imported"))
    log = new.join(counts, "bundle_id", "left").select("bundle_id", F.current_timestamp().alias("imported_at"), "source_path", F.coalesce("rows_imported", F.lit(0)).alias("rows_imported"))
    return out | {"import_log": study["import_log"].unionByName(log)}
