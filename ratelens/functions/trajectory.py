"""Descriptors of a 16-point intensity curve, as staged column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import NO_CONSENSUS

#: Categories without a reading of their own, and the peak type each stands for.
REFERENCE_TYPES = {"Neutral": "neutral_reference", "Face not visible": "face_not_visible", NO_CONSENSUS: "no_consensus"}
DESCRIPTORS = [
    "start_intensity", "end_intensity", "start_end_difference", "mean_intensity", "onset_position", "apex_position",
    "offset_position", "peak_width", "peak_count", "peak_type", "expression_present_fraction",
    "high_intensity_fraction", "trajectory_total_variation", "mean_absolute_adjacent_change", "adjacent_differences",
]

_ALL = "sequence(0, 15)"
# plateaus {s, e, m}: runs of equal values that stand above both neighbours (the curve's outside is lower than all)
_TOPS = f"""filter(transform(filter({_ALL}, s -> s = 0 or _c[s - 1] <> _c[s]),
    s -> named_struct('s', s, 'e', coalesce(array_min(filter({_ALL}, j -> j > s and _c[j] <> _c[s])), 16) - 1)),
    p -> (p.s = 0 or _c[p.s - 1] < _c[p.s]) and (p.e = 15 or _c[p.e + 1] < _c[p.s]))"""
_MIDDLES = "transform(_tops, p -> cast((p.s + p.e) div 2 as int))"
# a top counts if the curve falls by 1 or more on each side before it rises above it; an outer side without a rise counts
_LEFT = f"array_max(filter({_ALL}, j -> j < m and _c[j] > _c[m]))"
_RIGHT = f"array_min(filter({_ALL}, j -> j > m and _c[j] > _c[m]))"
_PEAKS = f"""filter(transform(_middles, m -> named_struct('m', m, 'l', {_LEFT}, 'r', {_RIGHT})), p ->
    (p.l is null or _c[p.m] - array_min(slice(_c, p.l + 1, p.m - p.l + 1)) >= 1)
    and (p.r is null or _c[p.m] - array_min(slice(_c, p.m + 1, p.r - p.m + 1)) >= 1))"""


def with_descriptors(df: DataFrame, curve: str, category: str) -> DataFrame:
    """df with the descriptors of each curve and a column curve_error; a malformed curve has null descriptors."""
    names = ", ".join(f"'{n}'" for n in REFERENCE_TYPES)
    bad = f"{curve} is null or size({curve}) <> 16 or exists({curve}, v -> v is null or isnan(v) or abs(v) = double('Infinity'))"
    out = df.withColumn("curve_error", F.expr(f"case when {bad} then 'curve must hold 16 finite values' end"))
    out = out.withColumn("_c", F.expr(f"case when curve_error is null then cast({curve} as array<double>) end"))
    out = out.withColumns({
        "_mx": F.expr("array_max(_c)"), "_mn": F.expr("array_min(_c)"),
        "_at": F.expr(f"filter({_ALL}, i -> _c[i] = array_max(_c))"),
        "_present": F.expr(f"filter({_ALL}, i -> _c[i] >= 1)"),
        "_tops": F.expr(_TOPS),
        "_diff": F.expr("zip_with(slice(_c, 2, 15), slice(_c, 1, 15), (a, b) -> a - b)"),
        "_reference": F.expr(f"coalesce({category} in ({names}), false)"),
    })
    out = out.withColumns({
        "_apex": F.expr("cast(rint((get(_at, cast((size(_at) - 1) div 2 as int)) + get(_at, cast(size(_at) div 2 as int))) / 2.0) as int)"),
        "_middles": F.expr(_MIDDLES),
        "_silent": F.expr("not _reference and _mx < 1"),
    })
    low = "_c[i] < greatest(1.0d, _mx - 1)"
    out = out.withColumns({
        "_width": F.expr(f"coalesce(array_min(filter({_ALL}, i -> i > _apex and {low})), 16) - coalesce(array_max(filter({_ALL}, i -> i < _apex and {low})), -1) - 1"),
        "_peaks": F.expr(_PEAKS),
    })
    reading = "_c is not null and not _reference and not _silent"
    kinds = " ".join(f"when {category} = '{k}' then '{v}'" for k, v in REFERENCE_TYPES.items())
    out = out.withColumns({
        "start_intensity": F.expr("_c[0]"),
        "end_intensity": F.expr("_c[15]"),
        "start_end_difference": F.expr("_c[15] - _c[0]"),
        "mean_intensity": F.expr("aggregate(_c, 0.0d, (a, v) -> a + v) / 16"),
        "onset_position": F.expr(f"case when {reading} then array_min(_present) + 1 end"),
        "apex_position": F.expr(f"case when {reading} then _apex + 1 end"),
        "offset_position": F.expr(f"case when {reading} then array_max(_present) + 1 end"),
        "peak_width": F.expr(f"case when {reading} then _width end"),
        "peak_count": F.expr("case when _c is null or _reference then null when _silent or _mx - _mn < 1 then 0 else size(_peaks) end"),
        "peak_type": F.expr(f"case when _c is null then null {kinds} when _silent then 'no_visible_expression' when _mx - _mn < 1 then 'flat' when size(_peaks) > 1 then 'multiple' when get(_peaks, 0).m in (0, 15) then 'edge' else 'single' end"),
        "expression_present_fraction": F.expr("size(_present) / 16.0d"),
        "high_intensity_fraction": F.expr("size(filter(_c, v -> v >= 4)) / 16.0d"),
        "trajectory_total_variation": F.expr("aggregate(_diff, 0.0d, (a, v) -> a + abs(v))"),
        "mean_absolute_adjacent_change": F.expr("aggregate(_diff, 0.0d, (a, v) -> a + abs(v)) / 15"),
        "adjacent_differences": F.expr("transform(_diff, v -> round(v, 6))"),
    })
    out = out.withColumn("expression_present_fraction", F.expr("case when _c is not null then expression_present_fraction end")).withColumn("high_intensity_fraction", F.expr("case when _c is not null then high_intensity_fraction end"))
    return out.drop("_c", "_mx", "_mn", "_at", "_present", "_tops", "_diff", "_reference", "_apex", "_middles", "_silent", "_width", "_peaks")
