"""Descriptor goldens and a plain version on random curves."""

import numpy as np
import pytest

from ratelens.functions.trajectory import with_descriptors

RISE = [0, 0, 1, 2, 3, 4, 5, 6, 5, 4, 3, 2, 1, 0, 0, 0]
GOLDEN = [
    ("rise-fall", RISE, "Happiness", 3, 8, 13, 3, 1, "single", 0.6875, 0.3125, 12, 2.25),
    ("equal maxima", [0, 0, 6] + [0] * 7 + [6] + [0] * 5, "Surprise", 3, 7, 11, 1, 2, "multiple", 0.125, 0.125, 24, 0.75),
    ("shallow dip", [4, 3.5, 4] + [0] * 13, "Fear", 1, 2, 3, 3, 2, "multiple", 0.1875, 0.125, 5, 0.71875),
    ("left plateau", [5, 5] + [0] * 14, "Anger", 1, 1, 2, 2, 1, "edge", 0.125, 0.125, 5, 0.625),
    ("right plateau", [0] * 14 + [5, 5], "Anger", 15, 15, 16, 2, 1, "single", 0.125, 0.125, 5, 0.625),
    ("constant", [3] * 16, "Sadness", 1, 9, 16, 16, 0, "flat", 1, 0, 0, 3),
    ("faint", [0, 0.5] + [0] * 14, "Happiness", None, None, None, None, 0, "no_visible_expression", 0, 0, 1, 0.03125),
    ("neutral", [0] * 16, "Neutral", None, None, None, None, None, "neutral_reference", 0, 0, 0, 0),
    ("no consensus", RISE, "No consensus", None, None, None, None, None, "no_consensus", 0.6875, 0.3125, 12, 2.25),
    ("half-even apex", [0] * 4 + [2, 2] + [0] * 10, "Disgust", 5, 5, 6, 2, 1, "single", 0.125, 0, 4, 0.25),
    ("low bump", [0, 3, 2.5, 2.75] + [0] * 12, "Mixed", 2, 2, 4, 3, 1, "single", 0.1875, 0, 6.5, 0.515625),
]
COLUMNS = ["onset_position", "apex_position", "offset_position", "peak_width", "peak_count", "peak_type", "expression_present_fraction", "high_intensity_fraction", "trajectory_total_variation", "mean_intensity"]


def described(spark, rows):
    df = spark.createDataFrame(rows, "name string, curve array<double>, category string")
    return {r.name: r for r in with_descriptors(df, "curve", "category").collect()}


def test_goldens(spark):
    found = described(spark, [(g[0], [float(x) for x in g[1]], g[2]) for g in GOLDEN])
    for name, _, _, *wanted in GOLDEN:
        got = [found[name][c] for c in COLUMNS]
        assert got == [pytest.approx(w) if isinstance(w, float) else w for w in wanted], name


def test_malformed_curves_become_error_rows(spark):
    found = described(spark, [("short", [1.0] * 15, "Fear"), ("nan", [1.0] * 15 + [float("nan")], "Fear"), ("null", None, "Fear"), ("hole", [1.0] * 15 + [None], "Fear")])
    for row in found.values():
        assert row.curve_error and row.peak_type is None and row.mean_intensity is None and row.high_intensity_fraction is None


def plain_peaks(c):
    """Prominent tops, found by walking outwards from each."""
    out, i = [], 0
    while i < 16:
        j = i
        while j + 1 < 16 and c[j + 1] == c[i]:
            j += 1
        if (i == 0 or c[i - 1] < c[i]) and (j == 15 or c[j + 1] < c[i]):
            m, depth = (i + j) // 2, []
            for step in (-1, 1):
                k, low = m, c[m]
                while 0 <= k < 16 and c[k] <= c[m]:
                    low, k = min(low, c[k]), k + step
                depth.append(c[m] - low if 0 <= k < 16 else float("inf"))
            if min(depth) >= 1:
                out.append(m)
        i = j + 1
    return out


def test_random_curves(spark):
    rng = np.random.default_rng(3)
    curves = [[float(x) for x in rng.integers(0, 7, 16) / rng.choice([1, 2])] for _ in range(300)]
    found = described(spark, [(str(i), c, "Fear") for i, c in enumerate(curves)])
    for i, c in enumerate(curves):
        row, peaks = found[str(i)], plain_peaks(c)
        if max(c) >= 1 and max(c) - min(c) >= 1:
            kind = "multiple" if len(peaks) > 1 else "edge" if peaks[0] in (0, 15) else "single"
            assert (row.peak_count, row.peak_type) == (len(peaks), kind), c
            assert row.apex_position == 1 + int(np.rint(np.median(np.flatnonzero(np.array(c) == max(c)))))
