"""Column expressions: ids, votes, bins, rating rules and durations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..schemas import CATEGORIES, CURVE_POINTS, DAY_MS, EMOTIONS, LARGEST_INTENSITY

#: Fixed value: the namespace of the study's ids.
NAMESPACE = "3350bc80-5218-4d89-ae31-87ee4bdcc1c5"
_ZERO_ONLY = ["Neutral", "Face not visible"]
_ZERO_ALLOWED = ["Neutral", "Unclear", "Face not visible"]


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The version-5 UUID of a name, as text."""
    raw = F.sha1(F.concat(F.lit(uuid.UUID(namespace).bytes), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(raw, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.concat(F.lit("5"), F.substring(raw, 14, 3)), F.concat(variant, F.substring(raw, 18, 3)), F.substring(raw, 21, 12))


def stable_uuid(kind: str, *parts: Column | str | int) -> Column:
    """The study's id of a kind and its parts, joined by colons; a null part reads None."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return uuid5(F.concat_ws(":", F.lit(kind), *texts))


def emotion(label: Column) -> Column:
    """The emotion of a label from 1 to 7, else null."""
    return F.try_element_at(F.array(*map(F.lit, EMOTIONS)), F.when(label.between(1, len(EMOTIONS)), label.cast("int")).otherwise(99))


def vote_entropy(votes: list[Column]) -> Column:
    """Normalised entropy of votes (0 without votes): -sum(p ln p) / ln(number of classes)."""
    total = sum((v.cast("double") for v in votes), F.lit(0.0))
    share = [F.when(total > 0, v.cast("double") / total).otherwise(0.0) for v in votes]
    terms = [F.when(p > 0, p * F.ln(p)).otherwise(0.0) for p in share]
    return -sum(terms, F.lit(0.0)) / F.ln(F.lit(float(len(votes))))


def vote_max(votes: list[Column]) -> Column:
    return F.greatest(*votes)


def vote_margin(votes: list[Column]) -> Column:
    """The largest vote less the second largest."""
    ordered = F.sort_array(F.array(*votes), asc=False)
    return ordered[0] - ordered[1]


def quartile_bin(value: Column, order: list[Column], within: list[Column] | None = None) -> Column:
    """The quarter (0 to 3) of a value's rank among the non-null values, cut at linearly interpolated quantiles of the
    ranks; null for a null value and where fewer than four values are known. Ties follow the given order."""
    keys = [*(within or []), value.isNull()]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value, *order))
    known = F.count(value).over(Window.partitionBy(*keys))
    return F.when(value.isNotNull(), quarter(rank, known))


def quarter(rank: Column, known: Column) -> Column:
    """The quarter (0 to 3) of a rank from 1 among so many values; null for fewer than four."""
    return F.when(known >= 4, F.greatest(F.lit(0), F.ceil(F.lit(4) * (rank - 1) / (known - 1)) - 1).cast("int"))


def frame_rating_error(category: Column, intensity: Column) -> Column:
    """Why a frame rating is not accepted, or null."""
    return (
        F.when(category.isNull() | ~category.isin(CATEGORIES), "category")
        .when(intensity.isNull() | ~intensity.between(0, LARGEST_INTENSITY), "intensity")
        .when(category.isin(_ZERO_ONLY) & (intensity != 0), "must_be_zero")
        .when(~category.isin(_ZERO_ALLOWED) & (intensity < 1), "must_be_positive")
    )


def clip_rating_error(category: Column, points: Column) -> Column:
    """Why a clip rating (points as texts or numbers) is not accepted, or null."""
    whole = F.transform(points, lambda p: p.try_cast("int"))
    return (
        F.when(category.isNull() | ~category.isin(CATEGORIES), "category")
        .when(points.isNull() | (F.size(points) != CURVE_POINTS), "points")
        .when(~F.forall(whole, lambda p: p.isNotNull() & p.between(0, LARGEST_INTENSITY)), "intensity")
        .when(category.isin(_ZERO_ONLY) & F.exists(whole, lambda p: p != 0), "must_be_zero")
        .when(~category.isin(_ZERO_ALLOWED) & ~F.exists(whole, lambda p: p != 0), "must_be_positive")
    )


def flag(value: Column) -> Column:
    """0 or 1 of a boolean or number; null counts as 0."""
    return F.coalesce(value.cast("boolean"), F.lit(False)).cast("int")


def duration(ms: Column) -> Column:
    """A duration kept between 0 and a day; null stays null."""
    return F.when(ms.isNotNull(), F.greatest(F.lit(0), F.least(ms, F.lit(DAY_MS))).cast("bigint"))


def login_code(text: Column) -> Column:
    return F.upper(F.trim(text))


def percent_complete(complete: Column, total: Column) -> Column:
    return F.when(total > 0, 100.0 * F.coalesce(complete, F.lit(0)) / total).otherwise(0.0)


def bundle_id(code: Column, ids: Column) -> Column:
    """The id of a bundle: of its rater and the sorted ids in it."""
    return F.substring(F.sha2(F.concat(code, F.lit("|"), F.array_join(F.array_sort(ids), "|")), 256), 1, 20)


def stamp(text: Column) -> Column:
    """A timestamp from either text form that studies hold."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text))


def wide_curve(curve: Column, prefix: str = "intensity_") -> list[Column]:
    """The points of a curve as columns of their own."""
    return [F.get(curve, F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(CURVE_POINTS)]
