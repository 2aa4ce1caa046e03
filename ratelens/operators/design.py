"""Study design: clarity, selection, repeat samples, assignment, queues, calibration and practice sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import CURVE_POINTS, EMOTIONS
from ..shared import written
from . import order as order_of

#: Fixed values of the design: the class that is kept whole, and the frames that calibration cycles through.
WHOLE_LABEL, CALIBRATION_FRAMES = 6, [2, 6, 11, 15]
#: The tiers of a duplicate review that exclude training clips.
NEAR_TIERS = ["very_high_similarity", "high_similarity"]


def shuffled(seed: int, *keys: str | Column) -> Column:
    """A value to order by that stands for a random draw: the same for the same seed and keys on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def label_clarity(votes: DataFrame, columns: list[str], clip_col: str = "order", neutral: int = 2, validate: bool = False) -> DataFrame:
    """Vote statistics of each clip; with validate, rows whose votes are negative or do not add up to 10 are left out.

    See vote_violations() for the rows that validation rejects.
    """
    own = [F.col(c).cast("double") for c in columns]
    rows = votes.where(~_bad_votes(columns)) if validate else votes
    return rows.select(F.col(clip_col).cast("int").alias("clip_id"), C.vote_max(own).alias("vote_max"), C.vote_margin(own).alias("vote_margin"), C.vote_entropy(own).alias("vote_entropy"), own[neutral].alias("neutral_votes"), sum(own, F.lit(0.0)).alias("vote_total"))


def _bad_votes(columns: list[str], total: float = 10.0) -> Column:
    own = [F.col(c).cast("double") for c in columns]
    negative = F.exists(F.array(*own), lambda v: v.isNull() | (v < 0))
    return negative | (F.abs(sum(own, F.lit(0.0)) - total) > 1e-8 + 1e-5 * total)


def vote_violations(votes: DataFrame, columns: list[str]) -> DataFrame:
    return votes.where(_bad_votes(columns))


def placed(rows: DataFrame, within: list[str], value: str, order: list[str]) -> DataFrame:
    """rows with _place, the rank from 1 by a value and then by order among rows of the same within columns, and _known,
    how many of these have the value; rows without it have neither. Ties and missing values may be any share of the rows,
    as they are dealt by order too."""
    out = order_of.ranked(rows.withColumn("_lost", F.col(value).isNull()), [*within, "_lost"], [value, *order], "_place", "_known")
    return out.withColumns({c: F.when(~F.col("_lost"), F.col(c)) for c in ("_place", "_known")}).drop("_lost")


def quartiles(rows: DataFrame, name: str, value: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """rows with the quarter (see columns.quartile_bin) of a number, for groups of any size."""
    out = placed(rows, within or [], value, order)
    return out.withColumn(name, C.quarter(F.col("_place"), F.col("_known"))).drop("_place", "_known")


def primary_turns(rows: DataFrame, name: str, strata: list[str], value: str, offset: Column, order: list[str] | None = None, raters: int = 2) -> DataFrame:
    """rows with the number (from 0) of their primary rater: raters take turns in the order of a value, starting where the
    offset says, within strata of any size."""
    out = placed(rows, strata, value, order or [])
    return out.withColumn(name, F.pmod(F.col("_place") - 1 + offset, F.lit(raters)).cast("int")).drop("_place", "_known")


def largest_remainder(sizes: DataFrame, keys: list[str], target: Column, exact: Column, within: list[str] | None = None) -> DataFrame:
    """sizes with a column allocated: floors of the exact shares, the rest by largest fraction, then by key.

    target: how many are wanted in all (of each group of the within columns).
    """
    group = Window.partitionBy(*(within or [F.lit(1)]))
    rows = sizes.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact").cast("bigint"))
    rows = rows.withColumn("_left", target - F.sum("_floor").over(group))
    rank = F.row_number().over(group.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), *keys))
    return rows.withColumn("allocated", F.col("_floor") + (rank <= F.col("_left")).cast("bigint")).drop("_exact", "_floor", "_left")


def stratified_sample(rows: DataFrame, strata: list[str], fraction: float, draw: Column) -> DataFrame:
    """A sample of round-half-even(rows * fraction) rows, allocated to strata by largest remainder, without replacement:
    those of the smallest draws (see shuffled)."""
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("_n"))
    all_rows = F.sum("_n").over(Window.partitionBy(F.lit(1)))  # over strata, not over rows
    taken = largest_remainder(sizes.withColumn("_all", all_rows), strata, F.bround(F.col("_all") * fraction).cast("bigint"), F.col("_n") * fraction)
    return order_of.first_drawn(rows, strata, draw, taken, "allocated")


def alignment_subset(train: DataFrame, clarity: DataFrame, stimulus: DataFrame | None = None, per_class: int = 380, seed: int = 1) -> DataFrame:
    """The training clips for human alignment: one class whole, the others at most per_class clips, spread over strata
    of vote entropy, original length and motion; sorted by label and clip where written."""
    rows = train.join(clarity, "clip_id", "left")
    sources = [("vote_entropy", "clarity_bin")]
    if stimulus is not None:
        named = [c for c in ("original_frame_count", "mean_abs_change") if c in stimulus.columns]
        once = stimulus.withColumn("_n", F.row_number().over(Window.partitionBy("clip_id").orderBy(*named))).where("_n = 1")
        rows = rows.join(once.select("clip_id", *named), "clip_id", "left")
        sources += [(c, b) for c, b in (("original_frame_count", "length_bin"), ("mean_abs_change", "motion_bin")) if c in named]
    for source, name in sources:
        rows = quartiles(rows, name, source, ["clip_id"])
    stratum = F.concat_ws("|", *[F.coalesce(F.col(b), F.lit(-1)).cast("string") for _, b in sources])
    rows = rows.withColumn("_stratum", stratum)
    sizes = rows.groupBy("label", "_stratum").agg(F.count("*").alias("_n"))
    size = F.sum("_n").over(Window.partitionBy("label"))
    sizes = sizes.withColumn("_target", F.least(F.lit(per_class), size)).withColumn("_share", F.col("_n") * F.col("_target") / size)
    taken = largest_remainder(sizes, ["_stratum"], F.col("_target"), F.col("_share"), ["label"])
    quota = taken.select("label", "_stratum", F.when(F.col("label") == WHOLE_LABEL, F.col("_n")).otherwise(F.col("allocated")).alias("allocated"))
    return order_of.first_drawn(rows, ["label", "_stratum"], shuffled(seed, "clip_id"), quota, "allocated", ties=["clip_id"]).drop("_stratum")


def class_count_errors(selected: DataFrame, expected: DataFrame) -> DataFrame:
    """Classes whose number of clips is not as expected: rows (label, observed, expected)."""
    own = selected.groupBy("label").agg(F.count("*").alias("observed"))
    both = own.join(expected.select("label", "expected"), "label", "full")
    return both.select("label", F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("expected", F.lit(0)).alias("expected")).where("observed <> expected")


def frame_targets(test: DataFrame) -> DataFrame:
    """Each test clip's frames: rows (clip_id, label, frame_index)."""
    return test.select("clip_id", "label", F.explode(F.sequence(F.lit(1), F.lit(CURVE_POINTS))).alias("frame_index"))


def frame_design(test: DataFrame, raters: list[str], second_fraction: float, hidden_fraction: float, seed: int = 2) -> tuple[DataFrame, DataFrame]:
    """Frame tasks and their assignments: a primary rater for each frame, second ratings and hidden repeats for samples."""
    if len(raters) != 2:
        raise ValueError("the formal study takes exactly two raters")
    codes = F.array(*map(F.lit, raters))
    base = frame_targets(test)
    base = base.withColumn("_draw", shuffled(seed, "clip_id", "frame_index"))
    base = primary_turns(base, "_turn", ["label", "frame_index"], "_draw", F.col("label") + F.col("frame_index"), ["clip_id"]).drop("_draw")
    base = base.withColumn("base_uuid", C.stable_uuid("frame", "test", F.col("clip_id"), F.col("frame_index"), "primary"))
    rows = base.select("clip_id", "frame_index", F.col("base_uuid").alias("task_uuid"), F.lit(None).cast("string").alias("source_task_uuid"), F.lit("none").alias("repeat_kind"), F.element_at(codes, F.col("_turn") + 1).alias("annotator_code"), F.lit("primary").alias("role"))
    second = stratified_sample(base, ["label", "frame_index"], second_fraction, shuffled(seed + 1, "clip_id", "frame_index"))
    hidden = stratified_sample(base, ["label", "frame_index"], hidden_fraction, shuffled(seed + 2, "clip_id", "frame_index"))
    own = F.element_at(codes, F.col("_turn") + 1)
    rows = rows.unionByName(second.select("clip_id", "frame_index", C.stable_uuid("frame", "test", F.col("clip_id"), F.col("frame_index"), "second").alias("task_uuid"), F.col("base_uuid").alias("source_task_uuid"), F.lit("second_rater").alias("repeat_kind"), F.element_at(codes, 2 - F.col("_turn")).alias("annotator_code"), F.lit("second").alias("role")))
    rows = rows.unionByName(hidden.select("clip_id", "frame_index", C.stable_uuid("frame", "test", F.col("clip_id"), F.col("frame_index"), "hidden", own).alias("task_uuid"), F.col("base_uuid").alias("source_task_uuid"), F.lit("within_rater").alias("repeat_kind"), own.alias("annotator_code"), F.lit("hidden_repeat").alias("role")))
    tasks = rows.select("task_uuid", F.lit("frame").alias("task_type"), F.lit("test").alias("split"), "clip_id", "frame_index", "source_task_uuid", "repeat_kind")
    assignments = rows.select(C.stable_uuid("assignment", F.col("task_uuid"), F.col("annotator_code"), F.col("role")).alias("assignment_uuid"), "task_uuid", "annotator_code", "role", "clip_id")
    return tasks, assignments


def clip_design(clips: DataFrame, split: str, raters: list[str]) -> tuple[DataFrame, DataFrame]:
    """Clip tasks of a split, each for all raters: the first is primary, the others are second."""
    rows = clips.select("clip_id", C.stable_uuid("clip", split, F.col("clip_id")).alias("task_uuid"))
    tasks = rows.select("task_uuid", F.lit("clip").alias("task_type"), F.lit(split).alias("split"), "clip_id", F.lit(None).cast("int").alias("frame_index"), F.lit(None).cast("string").alias("source_task_uuid"), F.lit("none").alias("repeat_kind"))
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("code")) for i, c in enumerate(raters)])
    rows = rows.withColumn("r", F.explode(each))
    role = F.when(F.col("r.i") == 0, "primary").otherwise("second")
    return tasks, rows.select(C.stable_uuid("assignment", F.col("task_uuid"), F.col("r.code"), F.concat(F.lit("clip"), F.col("r.i").cast("string"))).alias("assignment_uuid"), "task_uuid", F.col("r.code").alias("annotator_code"), role.alias("role"), "clip_id")


#: Places of a schedule's round that are shuffled among one another at most.
CHUNK = 1024


def schedule_needs(items: DataFrame, gap: int, rater: str = "annotator_code", clip: str = "clip_id") -> DataFrame:
    """For each rater the items, the most of one clip (largest), the clips that have as many (ties), the least number of
    items that a schedule with the gap takes (needed), and whether there is one (feasible).

    Between two items of a clip lie more than gap others, so the items of a largest clip are the heads of largest - 1
    rounds of gap + 1 places, and a last place for each of the ties: no schedule is shorter, and any longer one can be filled.
    """
    return _needs(items.groupBy(F.col(rater).alias("rater"), clip).agg(F.count("*").alias("n")), gap)


def _needs(counts: DataFrame, gap: int) -> DataFrame:
    """schedule_needs() of a table of the items (n) of each rater and clip."""
    by_size = counts.groupBy("rater", "n").agg(F.count("*").alias("clips"))
    out = by_size.groupBy("rater").agg(F.sum(F.col("n") * F.col("clips")).alias("items"), F.max("n").alias("largest"), F.max_by("clips", "n").alias("ties"))
    out = out.withColumn("needed", (F.col("largest") - 1) * (gap + 1) + F.col("ties"))
    return out.withColumn("feasible", F.col("needed") <= F.col("items"))


def scheduled(items: DataFrame, gap: int, seed: int = 5, rater: str = "annotator_code", item: str = "assignment_uuid", clip: str = "clip_id", block: int = order_of.BLOCK) -> DataFrame:
    """Rows (rater, item, clip, position): each rater's items in an order that keeps the gap; position is null for raters
    who can have none (see schedule_needs). Raters may have any number of items.

    Clips are dealt out by falling number of items, drawn among equals. The clips of most items have one in each round, the
    others go on from round to round but the last, so every round has more than gap items and a clip keeps its place from
    one round to the next; clips that go past the last such round have a round without them between. Where rounds are
    longer than the gap needs, neighbouring places are shuffled within each round, by as many places as may be lost.

    Items are shuffled twice: to their clip, where their draws rank them, and to their part of a round. Clips of more than
    block items, of which there are few, are dealt over bins of about as many by the first digits of the draws. What a bin
    starts at comes from the counts, a table of one row for each rater, clip and bin.
    """
    names = [F.col(rater).alias("rater"), F.col(item).cast("string").alias("item"), F.col(clip).cast("bigint").alias("clip")]
    rows = items.select(*names)
    counts = written(rows.groupBy("rater", "clip").agg(F.count("*").alias("n")))
    draw = F.unhex(shuffled(seed, "item"))
    bins = counts.where(F.col("n") > block).select(F.struct("rater", "clip").alias("own"), "n", F.ceil(F.col("n") / block).alias("bins"))
    first = F.conv(F.hex(F.substring(draw, 1, 4)), 16, 10).cast("bigint")  # 32 bits, in the order of the draws
    own = F.struct("rater", "clip")  # structs are equal where their nulls are
    binned = rows.join(F.broadcast(bins), own == F.col("own"), "left").withColumn("bin", F.when(F.col("bins").isNotNull(), F.shiftright(first * F.col("bins"), 32)))
    parts = counts.where(F.col("n") <= block).select("rater", "clip", "n", F.lit(None).cast("bigint").alias("bin"), F.col("n").alias("size"))
    parts = parts.unionByName(binned.where("bins IS NOT NULL").groupBy("rater", "clip", "n", "bin").agg(F.count("*").alias("size")))
    parts = order_of.running(parts.withColumn("clip_draw", shuffled(seed, "clip")), ["rater"], [F.desc("n"), "clip_draw", "clip", "bin"], "size", "up_to", "all")
    key = F.struct("rater", "clip", "bin").alias("key")  # nullable in both tables: of one type, so no cast deals the rows again
    needs = _needs(counts, gap).select(F.col("rater").alias("_r"), "largest", "ties", "feasible")
    parts = parts.join(needs, F.col("rater").eqNullSafe(F.col("_r"))).select(key, (F.col("up_to") - F.col("size")).alias("before"), "all", "largest", "ties", "feasible")
    number = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # so none is merged: they are sorted twice
    rows = binned.select(key, "item").repartition(number, "key").join(parts, "key").withColumn("draw", draw)
    here = Window.partitionBy("key").orderBy("draw", "item")  # a bin
    rows = rows.withColumn("s", F.col("before") + F.row_number().over(here) - 1).select("key.rater", "item", "key.clip", "s", "all", "largest", "ties", "feasible")
    heads = F.col("largest") * F.col("ties")
    rounds = F.greatest(F.col("largest") - 1, F.lit(1))
    rows = rows.withColumns({"rest": F.col("s") - heads, "rounds": rounds, "left": F.col("all") - heads})
    head = F.col("rest") < 0
    even = F.expr("ties + left div rounds")  # places of a round; the first ones have one more where it does not come out even
    rows = rows.withColumns({"round": F.when(head, F.expr("s % largest")).otherwise(F.expr("rest % rounds")), "at": F.when(head, F.expr("s div largest")).otherwise(F.expr("ties + rest div rounds")), "even": even})
    chunk = F.greatest(F.least(F.when(F.col("largest") > 1, F.col("even") - gap).otherwise(F.col("all")), F.lit(CHUNK)), F.lit(1))
    rows = rows.withColumn("chunk", chunk).withColumn("part", F.expr("at div chunk"))
    start = F.col("round") * F.col("even") + F.least(F.col("round"), F.expr("left % rounds"))
    rows = rows.select("rater", "item", "clip", "feasible", (start + F.col("part") * F.col("chunk")).alias("base"))
    rows = rows.repartition("rater", "base").withColumn("draw", F.unhex(shuffled(seed + 1, "item")))  # drawn where it is needed
    by = Window.partitionBy("rater", "base").orderBy("draw", "item")  # a part of a round, of at most CHUNK rows
    out = rows.withColumn("position", F.when(F.col("feasible"), F.col("base") + F.row_number().over(by)).cast("int"))
    return out.select(F.col("rater").alias(rater), F.col("item").alias(item), F.col("clip").alias(clip), "position")


def queues(frames: DataFrame, clips: DataFrame, seed: int = 6) -> DataFrame:
    """Queue positions from 1: scheduled frames first, then clips in shuffled order."""
    rows = frames.select("annotator_code", "assignment_uuid", F.lit(0).alias("_phase"), F.lit("").alias("_tie"), F.col("position").alias("_at"))
    rows = rows.unionByName(clips.select("annotator_code", "assignment_uuid", F.lit(1).alias("_phase"), shuffled(seed, "assignment_uuid").alias("_tie"), F.lit(0).alias("_at")))
    out = order_of.ranked(rows, ["annotator_code"], ["_phase", "_at", "_tie", "assignment_uuid"], "queue_position")
    return out.select("annotator_code", "assignment_uuid", F.col("queue_position").cast("int").alias("queue_position"))


def prepare_study(test: DataFrame, alignment: DataFrame, raters: list[str], second_fraction: float = 0.10, hidden_fraction: float = 0.02, gap: int = 9) -> tuple[DataFrame, DataFrame]:
    """The tasks and queued assignments of a new study."""
    frame_tasks, frame_work = (written(df) for df in frame_design(test, raters, second_fraction, hidden_fraction))
    test_tasks, test_work = clip_design(test, "test", raters)
    train_tasks, train_work = clip_design(alignment, "train_alignment", raters)
    tasks = frame_tasks.unionByName(test_tasks).unionByName(train_tasks)
    work = frame_work.unionByName(test_work).unionByName(train_work)
    if found := schedule_needs(frame_work, gap).where("NOT feasible").take(len(raters)):
        raise ValueError(f"frame tasks can't keep a gap of {gap} tasks between frames of a clip: {found}")
    order = queues(scheduled(frame_work, gap), test_work.unionByName(train_work))
    return tasks, work.join(order, ["annotator_code", "assignment_uuid"]).withColumn("status", F.lit("pending"))


def calibration_selection(candidates: DataFrame, per_class: int = 4, label: str = "label", order: tuple[Column, ...] | None = None, clip: str = "clip_id", overlap: str = "main_study_overlap") -> DataFrame:
    """Of each class the clearest ceil(k/2) clips and the floor(k/2) at the category boundary, from clips outside the
    main study if there are enough. Classes with fewer than k clips give no rows (see calibration_shortfall)."""
    order = order or (F.col("vote_entropy").asc(), F.col("vote_margin").desc(), F.col(clip).asc())
    clear = (per_class + 1) // 2
    group = Window.partitionBy(label)
    rows = candidates.withColumn("_outside", F.count_if(~F.col(overlap)).over(group)).where((F.col("_outside") < per_class) | ~F.col(overlap))
    rows = rows.withColumn("_n", F.count("*").over(group)).withColumn("_rank", F.row_number().over(group.orderBy(*order))).where(F.col("_n") >= per_class)
    profile = F.when(F.col("_rank") <= clear, "clear").when(F.col("_rank") > F.col("_n") - (per_class - clear), "category_boundary")
    return rows.withColumn("calibration_profile", profile).where("calibration_profile IS NOT NULL").drop("_outside", "_n", "_rank").withColumn("reference_status", F.lit("discussion_anchor_not_gold"))


def calibration_shortfall(candidates: DataFrame, per_class: int = 4, label: str = "label") -> DataFrame:
    return candidates.groupBy(label).agg(F.count("*").alias("eligible")).where(F.col("eligible") < per_class)


def calibration_manifest(picked: DataFrame, label: str = "label") -> DataFrame:
    """The blind manifest of calibration_frames(): rows (place, clip_id, task_type, frame_index), first all frames, then all
    clips, each by class, profile and clip."""
    own = picked.select("clip_id", label, "calibration_profile", "frame_index")
    frames = own.withColumns({"task_type": F.lit("frame"), "_phase": F.lit(0)})
    clips = own.withColumns({"task_type": F.lit("clip"), "_phase": F.lit(1), "frame_index": F.lit(None).cast("int")})
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_phase", label, "calibration_profile", "clip_id"))  # a few dozen rows
    return frames.unionByName(clips).select(place.alias("place"), "clip_id", "task_type", "frame_index")


def calibration_frames(selected: DataFrame, label: str = "label", clip: str = "clip_id") -> DataFrame:
    """selected with the frame that each clip shows: positions are taken in turn within a class, by profile and clip."""
    by = Window.partitionBy(label).orderBy("calibration_profile", clip)
    turn = (F.row_number().over(by) - 1) % len(CALIBRATION_FRAMES)
    return selected.withColumn("frame_index", F.element_at(F.array(*map(F.lit, CALIBRATION_FRAMES)), turn + 1))


def prepare_calibration(manifest: DataFrame, annotators: DataFrame, tasks: DataFrame, assignments: DataFrame, n_raters: int = 3, position: str = "position") -> tuple[DataFrame, DataFrame]:
    """Tasks and assignments with the manifest at the head of every active rater's queue.

    The manifest has rows (clip_id, task_type, frame_index, position from 1). Existing ids win over new ones. The counts
    checked here are scalars: the number of active raters and whether calibration tasks exist.
    """
    codes = annotators.where("active = 1").select("code")
    if codes.count() != n_raters:
        raise ValueError(f"calibration needs {n_raters} active raters")
    if not tasks.where("split = 'calibration'").isEmpty():
        raise ValueError("calibration tasks exist already")
    new = manifest.withColumn("task_uuid", C.stable_uuid("calibration", F.col("task_type"), F.col("clip_id"), F.col("frame_index")))
    size = manifest.count()
    shifted = assignments.join(codes, assignments.annotator_code == codes.code, "left").withColumn("queue_position", F.col("queue_position") + F.when(F.col("code").isNotNull(), size).otherwise(0)).drop("code")
    new_tasks = new.select("task_uuid", "task_type", F.lit("calibration").alias("split"), "clip_id", "frame_index", F.lit(None).cast("string").alias("source_task_uuid"), F.lit("none").alias("repeat_kind")).dropDuplicates(["task_uuid"])
    work = new.crossJoin(F.broadcast(codes.withColumnRenamed("code", "annotator_code")))  # n_raters rows, as checked
    work = work.select(C.stable_uuid("assignment", F.col("task_uuid"), F.col("annotator_code"), "calibration").alias("assignment_uuid"), "task_uuid", "annotator_code", F.lit("primary").alias("role"), F.col(position).alias("queue_position"), F.lit("pending").alias("status"))
    out_tasks = tasks.unionByName(new_tasks.join(tasks.select("task_uuid"), "task_uuid", "left_anti"), allowMissingColumns=True)
    out_work = shifted.unionByName(work.join(assignments.select("assignment_uuid"), "assignment_uuid", "left_anti"), allowMissingColumns=True)
    return out_tasks, out_work


def practice_set(clips: DataFrame, formal: DataFrame, frames: int = 14, clip_tasks: int = 7, seed: int = 7) -> DataFrame:
    """Practice tasks from complete clips outside the formal study: rows (position, task_type, clip_id, frame_index); raises
    if there are too few such clips."""
    eligible = clips.select("clip_id").distinct().join(formal.select("clip_id"), "clip_id", "left_anti")
    picked = eligible.orderBy(shuffled(seed, "clip_id"), "clip_id").limit(frames + clip_tasks)
    if (found := picked.count()) < frames + clip_tasks:
        raise ValueError(f"a practice takes {frames + clip_tasks} complete clips that the formal study does not use; there are {found}")
    rows = picked.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(shuffled(seed, "clip_id"), "clip_id")))
    is_frame = F.col("position") <= frames
    return rows.select("position", F.when(is_frame, "frame").otherwise("clip").alias("task_type"), "clip_id", F.when(is_frame, (F.col("position") - 1) * 5 % CURVE_POINTS + 1).cast("int").alias("frame_index"))


def practice_study(chosen: DataFrame, rater: str) -> dict[str, DataFrame]:
    """The tables of a study in which one rater practises: a task and an assignment for each row of practice_set()."""
    spark = chosen.sparkSession
    is_frame = F.col("task_type") == "frame"
    rows = chosen.withColumn("task_uuid", F.when(is_frame, C.stable_uuid("practice-frame", F.col("clip_id"), F.col("frame_index"))).otherwise(C.stable_uuid("practice-clip", F.col("clip_id"))))
    tasks = rows.select("task_uuid", "task_type", F.lit("calibration").alias("split"), "clip_id", "frame_index", F.lit(None).cast("string").alias("source_task_uuid"), F.lit("none").alias("repeat_kind"))
    work = rows.select(C.stable_uuid("practice-assignment", F.col("task_uuid"), rater).alias("assignment_uuid"), "task_uuid", F.lit(rater).alias("annotator_code"), F.lit("primary").alias("role"), F.col("position").alias("queue_position"), F.lit("pending").alias("status"))
    counted = rows.agg(F.count_if(is_frame).alias("frames"), F.count_if(~is_frame).alias("clips")).select(F.explode(F.create_map(F.lit("practice_frame_tasks"), F.col("frames").cast("string"), F.lit("practice_clip_tasks"), F.col("clips").cast("string"))))
    fixed = spark.createDataFrame([("design_version", "practice-1"), ("practice_mode", "1"), ("formal_clip_overlap", "0")], "key string, value string")
    people = spark.createDataFrame([(rater, "Practice", 1)], "code string, display_name string, active int")
    return {"tasks": tasks, "assignments": work, "annotators": people, "study_meta": fixed.unionByName(counted)}


def excluded_duplicates(train: DataFrame, duplicates: DataFrame) -> DataFrame:
    """train without the clips that close duplicates name on their training side; without tiers nothing is excluded."""
    if "review_tier" not in duplicates.columns:
        return train
    near = duplicates.where(F.col("review_tier").isin(*NEAR_TIERS))
    ends = near.select(F.col("split_1").alias("split"), F.col("clip_id_1").alias("clip_id")).union(near.select("split_2", "clip_id_2"))
    return train.join(ends.where("split = 'train'").select("clip_id").distinct(), "clip_id", "left_anti")


def demo_study(spark) -> tuple[DataFrame, DataFrame]:
    """Synthetic clips and votes: 21 clips with their labels and splits, 8 votes on the own label and 2 on the next."""
    n = len(EMOTIONS)
    clips = spark.range(1, 22).select(F.col("id").cast("int").alias("clip_id"), ((F.col("id") - 1) % n + 1).cast("int").alias("label")).withColumn("split", F.when(F.col("clip_id") <= n, "test").otherwise("train"))
    votes = clips.select(*[F.when(F.col("label") == i, 8).when(F.col("label") % n + 1 == i, 2).otherwise(0).alias(f"{i}{e}") for i, e in enumerate(["happy", "sad", "neutral", "angry", "surprise", "disgust", "fear"], 1)], F.col("clip_id").alias("order"), "label")
    return clips, votes
