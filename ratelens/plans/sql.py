"""DuckDB SQL of the catalog's queries over the driver's tables."""

from __future__ import annotations

import re

_ASSIGNED = """a AS (
  SELECT l_orderkey AS task_uuid, l_suppkey AS annotator_code, l_linenumber AS queue_position, l_partkey AS part,
    CASE l_returnflag WHEN 'A' THEN 'complete' WHEN 'N' THEN 'started' ELSE 'pending' END AS status,
    l_extendedprice AS duration_ms, o_orderpriority AS task_type, o_orderstatus AS split
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_CATEGORY = "['Happiness','Sadness','Neutral','Anger','Surprise','Disgust','Fear','Mixed','Unclear','Face not visible']"

_POINTS = f"""base AS (
  SELECT vec_id AS task_uuid, k, label, CAST(embedding[48 + k] AS DOUBLE) AS s, embedding
  FROM embeddings, (SELECT unnest([1, 2, 3]) AS k)),
pt AS (
  SELECT task_uuid, 'R0' || k AS annotator_code, CAST(i AS INTEGER) AS i,
    {_CATEGORY}[CAST((label + CASE WHEN s > 0.15 THEN 1 ELSE 0 END) % 10 + 1 AS INTEGER)] AS category,
    CAST(CAST(least(6, greatest(0, round(2 + label % 5 - abs(i - (task_uuid + CASE WHEN s > 0.1 THEN 5 ELSE 0 END) % 16) * (0.5 * (1 + task_uuid % 3))
      + 6 * CAST(embedding[16 * k + i + 1] AS DOUBLE)))) AS INTEGER) AS DOUBLE) AS v
  FROM base, (SELECT unnest(range(16)) AS i))"""


def _described(points: str, keys: str) -> str:
    """Descriptors in long form, of a relation of points (keys, category, i, v)."""
    on = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    x = ", ".join(f"x.{k}" for k in keys.split(", "))
    return f"""
d_base AS (
  SELECT {keys}, category, max(v) AS mx, min(v) AS mn, max(v) FILTER (i = 0) AS c0, max(v) FILTER (i = 15) AS c15, sum(v ORDER BY i) / 16 AS mean_intensity,
    min(i) FILTER (v >= 1) + 1 AS onset, max(i) FILTER (v >= 1) + 1 AS offs, count(*) FILTER (v >= 1) / 16.0 AS present, count(*) FILTER (v >= 4) / 16.0 AS high
  FROM {points} GROUP BY {keys}, category),
d_step AS (SELECT {keys}, sum(d) AS tv FROM (SELECT {keys}, abs(v - lag(v) OVER (PARTITION BY {keys} ORDER BY i)) AS d FROM {points}) GROUP BY {keys}),
d_apex AS (SELECT {x}, CAST(round_even(median(x.i), 0) AS INTEGER) AS apex FROM {points} x JOIN d_base y ON {on} WHERE x.v = y.mx GROUP BY {x}),
d_low AS (
  SELECT {x}, coalesce(min(x.i) FILTER (x.i > z.apex AND x.v < greatest(1, y.mx - 1)), 16) - coalesce(max(x.i) FILTER (x.i < z.apex AND x.v < greatest(1, y.mx - 1)), -1) - 1 AS width
  FROM {points} x JOIN d_base y ON {on} JOIN d_apex z ON {on.replace("y.", "z.")} GROUP BY {x}),
d_run AS (SELECT {keys}, i, v, lag(v) OVER (PARTITION BY {keys} ORDER BY i) AS p, lead(v) OVER (PARTITION BY {keys} ORDER BY i) AS n FROM {points}),
d_start AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> v THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY i) AS g FROM d_run),
d_top AS (
  SELECT {keys}, g, any_value(v) AS h, (min(i) + max(i)) // 2 AS m FROM d_start GROUP BY {keys}, g
  HAVING (min(i) = 0 OR arg_min(p, i) < any_value(v)) AND (max(i) = 15 OR arg_max(n, i) < any_value(v))),
d_side AS (
  SELECT y.{keys.replace(", ", ", y.")}, y.g, y.h, y.m, max(x.i) FILTER (x.i < y.m AND x.v > y.h) AS l, min(x.i) FILTER (x.i > y.m AND x.v > y.h) AS r
  FROM d_top y JOIN {points} x ON {on} GROUP BY y.{keys.replace(", ", ", y.")}, y.g, y.h, y.m),
d_peak AS (
  SELECT y.{keys.replace(", ", ", y.")}, y.m FROM d_side y JOIN {points} x ON {on} GROUP BY y.{keys.replace(", ", ", y.")}, y.g, y.h, y.m, y.l, y.r
  HAVING (y.l IS NULL OR y.h - min(x.v) FILTER (x.i >= y.l AND x.i <= y.m) >= 1) AND (y.r IS NULL OR y.h - min(x.v) FILTER (x.i <= y.r AND x.i >= y.m) >= 1)),
d_count AS (SELECT {keys}, count(*) AS n, min(m) AS m FROM d_peak GROUP BY {keys}),
described AS (
  SELECT x.{keys.replace(", ", ", x.")}, x.category, c0 AS start_intensity, c15 AS end_intensity, c15 - c0 AS start_end_difference, mean_intensity,
    CASE WHEN reading THEN onset END AS onset_position, CASE WHEN reading THEN apex + 1 END AS apex_position, CASE WHEN reading THEN offs END AS offset_position,
    CASE WHEN reading THEN width END AS peak_width,
    CASE WHEN ref THEN NULL WHEN mx < 1 OR mx - mn < 1 THEN 0 ELSE n END AS peak_count,
    CASE category WHEN 'Neutral' THEN 'neutral_reference' WHEN 'Face not visible' THEN 'face_not_visible' WHEN 'No consensus' THEN 'no_consensus'
      ELSE CASE WHEN mx < 1 THEN 'no_visible_expression' WHEN mx - mn < 1 THEN 'flat' WHEN n > 1 THEN 'multiple' WHEN m IN (0, 15) THEN 'edge' ELSE 'single' END END AS peak_type,
    present AS expression_present_fraction, high AS high_intensity_fraction, tv AS trajectory_total_variation, tv / 15 AS mean_absolute_adjacent_change
  FROM (SELECT *, category IN ('Neutral', 'Face not visible', 'No consensus') AS ref, NOT category IN ('Neutral', 'Face not visible', 'No consensus') AND mx >= 1 AS reading FROM d_base) x
  JOIN d_step y1 ON {on.replace("y.", "y1.")} JOIN d_apex y2 ON {on.replace("y.", "y2.")} JOIN d_low y3 ON {on.replace("y.", "y3.")} LEFT JOIN d_count y4 ON {on.replace("y.", "y4.")})"""


_DESCRIBED = _described("pt", "task_uuid, annotator_code")

_DISAGREE = """dis AS (
  SELECT a.task_uuid, a.category AS ca, b.category AS cb,
    concat_ws('|', CASE WHEN a.category <> b.category THEN 'category' END, CASE WHEN g.gap >= 3 THEN 'intensity_gap' END,
      CASE WHEN abs(a.apex_position - b.apex_position) >= 4 THEN 'peak_gap' END, CASE WHEN a.peak_type <> b.peak_type THEN 'peak_type' END) AS reasons
  FROM described a JOIN described b ON a.task_uuid = b.task_uuid AND a.annotator_code = 'R01' AND b.annotator_code = 'R02'
  JOIN (SELECT x.task_uuid, max(abs(x.v - y.v)) AS gap FROM pt x JOIN pt y ON x.task_uuid = y.task_uuid AND x.i = y.i AND x.annotator_code = 'R01' AND y.annotator_code = 'R02' GROUP BY x.task_uuid) g ON g.task_uuid = a.task_uuid)"""

# every task has an adjudicator's rating here, which counts (and is used) whether or not the other two disagree
_AGREED = """agreed AS (
  SELECT d.task_uuid, d.reasons, d.reasons <> '' AS needed, t.category AS third,
    CASE WHEN ca = cb OR t.category = ca THEN ca WHEN t.category = cb THEN cb ELSE 'No consensus' END AS category
  FROM dis d JOIN described t ON t.task_uuid = d.task_uuid AND t.annotator_code = 'R03'),
cpt AS (SELECT p.task_uuid, g.category, p.i, median(p.v) AS v FROM pt p JOIN agreed g ON g.task_uuid = p.task_uuid GROUP BY p.task_uuid, g.category, p.i)"""


def _wide(points: str) -> str:
    return ", ".join(f"max({points}.v) FILTER ({points}.i = {i}) AS intensity_{i + 1}" for i in range(16))


_FRAMES = f"""f AS (
  SELECT event_id AS task_uuid, CASE WHEN event_id <> base THEN base END AS source_task_uuid,
    CASE WHEN event_id = base THEN 'none' WHEN event_id % 2 = 0 THEN 'second_rater' ELSE 'within_rater' END AS repeat_kind,
    'R' || (event_id % 4) AS annotator_code, {_CATEGORY}[CAST(event_id % 10 + 1 AS INTEGER)] AS category,
    CAST(floor(abs(value) % 7) AS INTEGER) AS intensity, user_id AS clip_id, event_type AS frame
  FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS base FROM events))"""

SQL: dict[str, str] = {}

SQL["status_counts"] = f"""WITH {_ASSIGNED} SELECT annotator_code, task_type, split, count(*) AS total,
  CAST(count(*) FILTER (status = 'complete') AS BIGINT) AS complete, CAST(count(*) FILTER (status = 'started') AS BIGINT) AS started FROM a GROUP BY ALL"""

SQL["next_task"] = f"""WITH {_ASSIGNED} SELECT annotator_code, task_uuid, queue_position, part, status FROM a WHERE status <> 'complete'
  QUALIFY row_number() OVER (PARTITION BY annotator_code ORDER BY CASE WHEN status = 'started' THEN 0 ELSE 1 END, queue_position, task_uuid, part) = 1"""

SQL["workload"] = f"""WITH {_ASSIGNED},
done AS (SELECT * FROM a WHERE status = 'complete' AND duration_ms > 0),
own AS (SELECT annotator_code, task_type, median(duration_ms) AS own FROM done GROUP BY ALL),
pooled AS (SELECT task_type, median(duration_ms) AS pooled FROM done GROUP BY ALL),
c AS (SELECT annotator_code, task_type, split, count(*) AS total, count(*) FILTER (status = 'complete') AS completed FROM a GROUP BY ALL)
SELECT annotator_code, task_type, split, total, completed, total - completed AS remaining, round(coalesce(own, pooled) / 1000, 6) AS median_completed_seconds,
  round((total - completed) * coalesce(own, pooled) / 3.6e6, 6) AS estimated_remaining_hours
FROM c LEFT JOIN own USING (annotator_code, task_type) LEFT JOIN pooled USING (task_type)"""

SQL["completion_gate"] = f"""WITH {_ASSIGNED},
c AS (SELECT task_type, split, queue_position, count(*) AS total, CASE WHEN split = 'F' THEN count(*) ELSE count(*) FILTER (status = 'complete') END AS complete FROM a GROUP BY task_type, split, queue_position)
SELECT split, queue_position, bool_and(complete = total) AS all_complete FROM c GROUP BY ALL"""

SQL["rater_totals"] = f"""WITH {_ASSIGNED} SELECT annotator_code, count(*) AS total, CAST(count(*) FILTER (status = 'complete') AS BIGINT) AS complete,
  CAST(count(*) FILTER (status = 'started') AS BIGINT) AS started, round(100.0::DOUBLE * count(*) FILTER (status = 'complete') / count(*), 6) AS percent FROM a GROUP BY annotator_code"""

SQL["task_probes"] = f"""WITH {_ASSIGNED}, r AS (SELECT *, row_number() OVER (PARTITION BY annotator_code ORDER BY task_uuid, queue_position, part) AS n, count(*) OVER (PARTITION BY annotator_code) AS k FROM a)
SELECT annotator_code, task_uuid, queue_position, part FROM r WHERE n IN (1, k // 2 + 1, k)"""

SQL["task_authorised"] = f"""WITH {_ASSIGNED} SELECT o_orderkey AS task_uuid, o_custkey AS wanted_by FROM orders WHERE EXISTS (SELECT 1 FROM a WHERE task_uuid = o_orderkey AND status = 'complete')"""

SQL["unassigned"] = "SELECT o_orderkey AS task_uuid FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"

SQL["vote_clarity"] = """WITH kinds AS (SELECT unnest(range(7)) AS i), e AS (SELECT user_id, event_id % 7 * (event_id % 3) % 7 AS i, event_id FROM events),
n AS (SELECT user_id, i, CAST(count(event_id) AS DOUBLE) AS v FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN kinds LEFT JOIN e USING (user_id, i) GROUP BY ALL),
r AS (SELECT *, sum(v) OVER (PARTITION BY user_id) AS t, row_number() OVER (PARTITION BY user_id ORDER BY v DESC) AS o FROM n)
SELECT CAST(user_id AS INTEGER) AS clip_id, max(v) AS vote_max, max(v) FILTER (o = 1) - max(v) FILTER (o = 2) AS vote_margin,
  round(-sum(CASE WHEN v > 0 THEN v / t * ln(v / t) ELSE 0 END) / ln(7.0), 6) AS vote_entropy, max(v) FILTER (i = 2) AS neutral_votes, max(t) AS vote_total FROM r GROUP BY user_id"""

SQL["quartile_bin"] = """WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n >= 4 THEN CAST(greatest(0, ceil(4.0 * (r - 1) / (n - 1)) - 1) AS INTEGER) END AS quarter FROM r"""

_ALLOCATED = """n AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL),
fl AS (SELECT *, n * 0.1::DOUBLE AS e, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS f FROM n),
al AS (SELECT *, CAST(round_even(sum(n) OVER () * 0.1::DOUBLE, 0) - sum(f) OVER () AS BIGINT) AS rest, row_number() OVER (ORDER BY round(e - f, 9) DESC, o_orderpriority, o_orderstatus) AS k FROM fl),
allocated AS (SELECT o_orderpriority, o_orderstatus, n, CAST(f + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM al)"""

SQL["largest_remainder"] = f"WITH {_ALLOCATED} SELECT * FROM allocated"

SQL["stratified_sample"] = f"""WITH {_ALLOCATED}, r AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5('7|' || o_orderkey)) AS k FROM orders)
SELECT o_orderkey, o_orderpriority, o_orderstatus FROM r JOIN allocated USING (o_orderpriority, o_orderstatus) WHERE k <= allocated"""


def _bin(value: str) -> str:
    return f"CASE WHEN count(*) OVER () >= 4 THEN CAST(greatest(0, ceil(4.0 * (row_number() OVER (ORDER BY {value}, doc_id) - 1) / (count(*) OVER () - 1)) - 1) AS INTEGER) END"


SQL["alignment_subset"] = f"""WITH b AS (SELECT doc_id, doc_id % 7 + 1 AS label, {_bin("doc_id * 37 % 101 / 101.0")} AS clarity_bin, {_bin("n_chars")} AS length_bin, {_bin("doc_id * 53 % 97 / 97.0")} AS motion_bin FROM documents),
s AS (SELECT *, concat_ws('|', clarity_bin, length_bin, motion_bin) AS s FROM b),
n AS (SELECT label, s, count(*) AS n FROM s GROUP BY ALL),
e AS (SELECT *, least(60, sum(n) OVER (PARTITION BY label)) AS t, n * least(60, sum(n) OVER (PARTITION BY label)) / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE) AS e FROM n),
f AS (SELECT *, t - sum(floor(e)) OVER (PARTITION BY label) AS rest, row_number() OVER (PARTITION BY label ORDER BY round(e - floor(e), 9) DESC, s) AS k FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY label, s ORDER BY md5('1|' || doc_id), doc_id) AS r FROM s)
SELECT r.doc_id AS clip_id, r.label, clarity_bin, length_bin, motion_bin FROM r JOIN f ON r.label = f.label AND r.s = f.s WHERE r.label = 6 OR r <= floor(e) + CASE WHEN k <= rest THEN 1 ELSE 0 END"""

SQL["alternating_primary"] = "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 + o_custkey % 7) % 2 AS INTEGER) AS \"primary\" FROM orders"

SQL["stable_uuid"] = """WITH h AS (SELECT o_orderkey, sha1(unhex('3350bc8052184d89ae3187ee4bdcc1c5') || encode('frame:test:' || o_orderkey || ':' || coalesce(CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR) END, 'None') || ':primary')) AS h FROM orders)
SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', 1 + instr('0123456789abcdef', substr(h, 17, 1)) - 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS task_uuid FROM h"""

SQL["bundle_ids"] = "SELECT user_id, substr(sha256('R' || user_id || '|' || string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY CAST(event_id AS VARCHAR))), 1, 20) AS bundle_id FROM events GROUP BY user_id"

SQL["calibration_pick"] = """WITH c AS (SELECT doc_id, lang, n_chars, doc_id % 2 = 0 AS o, count(*) FILTER (doc_id % 2 <> 0) OVER (PARTITION BY lang) AS outside FROM documents),
r AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS k FROM c WHERE outside < 5 OR NOT o),
p AS (SELECT *, CASE WHEN k <= 3 THEN 'clear' WHEN k > n - 2 THEN 'category_boundary' END AS p FROM r WHERE n >= 5)
SELECT lang AS label, doc_id AS clip_id, p AS calibration_profile, [2, 6, 11, 15][CAST((row_number() OVER (PARTITION BY lang ORDER BY p, doc_id) - 1) % 4 + 1 AS INTEGER)] AS frame_index FROM p WHERE p IS NOT NULL"""

SQL["practice_set"] = """WITH r AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) AS INTEGER) AS position FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT position, CASE WHEN position <= 14 THEN 'frame' ELSE 'clip' END AS task_type, doc_id AS clip_id, CASE WHEN position <= 14 THEN CAST((position - 1) * 5 % 16 + 1 AS INTEGER) END AS frame_index FROM r WHERE position <= 21"""

SQL["gap_violations"] = """WITH p AS (SELECT user_id, event_type, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS position FROM events),
l AS (SELECT *, lag(position) OVER (PARTITION BY user_id, event_type ORDER BY position) AS previous FROM p)
SELECT * FROM l WHERE position - previous <= 2"""

SQL["active_time"] = """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, event_type <> 'error' AS v, event_id FROM events),
l AS (SELECT user_id, CASE WHEN lag(v) OVER w THEN least(t - lag(t) OVER w, 3600000) END AS g FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, CAST(coalesce(sum(g), 0) AS BIGINT) AS active_ms FROM l GROUP BY user_id"""

SQL["latest_draft"] = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"

SQL["trajectory_long"] = f"WITH {_POINTS} SELECT task_uuid, annotator_code, i + 1 AS position, v AS intensity FROM pt"

SQL["trajectory_wide"] = f"WITH {_POINTS} SELECT task_uuid, annotator_code, category, {_wide('pt')} FROM pt GROUP BY task_uuid, annotator_code, category"

SQL["descriptors"] = f"""WITH {_POINTS}, {_DESCRIBED}
SELECT task_uuid, annotator_code, start_intensity, end_intensity, start_end_difference, round(mean_intensity, 6) AS mean_intensity, onset_position, apex_position, offset_position, peak_width, CAST(peak_count AS INTEGER) AS peak_count, peak_type,
  CAST(expression_present_fraction AS DOUBLE) AS expression_present_fraction, CAST(high_intensity_fraction AS DOUBLE) AS high_intensity_fraction, trajectory_total_variation, round(mean_absolute_adjacent_change, 6) AS mean_absolute_adjacent_change FROM described"""

SQL["disagreements"] = f"WITH {_POINTS}, {_DESCRIBED}, {_DISAGREE} SELECT task_uuid, reasons <> '' AS needed, reasons FROM dis"

SQL["consensus"] = f"""WITH {_POINTS}, {_DESCRIBED}, {_DISAGREE}, {_AGREED}, {re.sub(r"\bd_", "e_", _described("cpt", "task_uuid")).replace("described AS", "final AS")}
SELECT g.task_uuid, 3 AS n_ratings, g.category, g.needed, {_wide("c")}, any_value(apex_position) AS apex_position, any_value(peak_type) AS peak_type, CAST(any_value(peak_count) AS INTEGER) AS peak_count, round(any_value(mean_intensity), 6) AS mean_intensity
FROM agreed g JOIN cpt c ON c.task_uuid = g.task_uuid JOIN final f ON f.task_uuid = g.task_uuid GROUP BY g.task_uuid, g.category, g.needed"""

SQL["adjudication_records"] = f"WITH {_POINTS}, {_DESCRIBED}, {_DISAGREE}, {_AGREED} SELECT task_uuid, reasons, 'R03' AS third_annotator, third AS third_category, category AS final_category, 'complete' AS status FROM agreed WHERE needed"

SQL["reliability_pairs"] = f"""WITH {_FRAMES}
SELECT r.clip_id, r.frame, r.repeat_kind, b.annotator_code AS primary_annotator, r.annotator_code AS repeat_annotator, b.category AS primary_category, r.category AS repeat_category,
  CAST(b.category = r.category AS INTEGER) AS category_agreement, CAST(b.intensity AS DOUBLE) AS primary_intensity, CAST(r.intensity AS DOUBLE) AS repeat_intensity, CAST(abs(b.intensity - r.intensity) AS DOUBLE) AS absolute_intensity_gap
FROM f r JOIN f b ON r.source_task_uuid = b.task_uuid AND b.repeat_kind = 'none' WHERE r.repeat_kind <> 'none'"""

SQL["primary_duplicates"] = f"WITH {_FRAMES} SELECT clip_id, 'any' AS frame, count(*) AS primaries FROM f WHERE repeat_kind = 'none' GROUP BY clip_id HAVING count(*) > 1"

_REPORT = """c AS (SELECT DISTINCT task_uuid, annotator_code, category FROM pt),
g AS (SELECT x.task_uuid, avg(d) AS gap FROM (SELECT x.task_uuid, x.annotator_code, y.annotator_code AS other, avg(abs(x.v - y.v)) AS d FROM pt x JOIN pt y ON x.task_uuid = y.task_uuid AND x.i = y.i AND x.annotator_code < y.annotator_code GROUP BY ALL) x GROUP BY x.task_uuid),
report AS (SELECT task_uuid, CAST(count(*) AS INTEGER) AS n_completed, CAST(count(*) = 3 AND count(DISTINCT category) = 1 AS INTEGER) AS category_unanimous, string_agg(category, '|' ORDER BY annotator_code) AS categories, any_value(gap) AS mean_pairwise_intensity_gap FROM c JOIN g USING (task_uuid) GROUP BY task_uuid)"""

SQL["calibration_report"] = f"WITH {_POINTS}, {_REPORT} SELECT task_uuid, n_completed, category_unanimous, categories, round(mean_pairwise_intensity_gap, 6) AS mean_pairwise_intensity_gap FROM report"

SQL["calibration_summary"] = f"WITH {_POINTS}, {_REPORT} SELECT count(*) AS completed, round(avg(category_unanimous), 6) AS unanimity, round(avg(mean_pairwise_intensity_gap), 6) AS mean_gap FROM report WHERE n_completed = 3"

SQL["rating_errors"] = f"""WITH {_FRAMES}, x AS (SELECT task_uuid, CASE WHEN task_uuid % 11 = 0 THEN 'Boredom' ELSE category END AS c, CASE WHEN task_uuid % 13 = 0 THEN 9 ELSE intensity END AS v FROM f)
SELECT task_uuid, CASE WHEN c = 'Boredom' THEN 'category' WHEN v NOT BETWEEN 0 AND 6 THEN 'intensity' WHEN c IN ('Neutral', 'Face not visible') AND v <> 0 THEN 'must_be_zero'
  WHEN c NOT IN ('Neutral', 'Unclear', 'Face not visible') AND v < 1 THEN 'must_be_positive' END AS error FROM x"""

SQL["clip_rating_errors"] = f"""WITH {_POINTS}, s AS (SELECT task_uuid, annotator_code, category, max(v) AS mx FROM pt GROUP BY ALL)
SELECT task_uuid, annotator_code, CASE WHEN task_uuid % 7 = 0 THEN 'points' WHEN task_uuid % 11 = 0 THEN 'intensity' WHEN category IN ('Neutral', 'Face not visible') AND mx > 0 THEN 'must_be_zero'
  WHEN category NOT IN ('Neutral', 'Unclear', 'Face not visible') AND mx = 0 THEN 'must_be_positive' END AS error FROM s"""

SQL["duration_clamp"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN CAST(greatest(0, least(CAST(trunc(o_totalprice * 1000 - 50000000) AS BIGINT), 86400000)) AS BIGINT) END AS duration_ms FROM orders"

SQL["class_count_errors"] = "SELECT o_orderpriority AS label, count(*) AS observed, CAST(3000 AS BIGINT) AS expected FROM orders GROUP BY ALL HAVING count(*) <> 3000"

SQL["split_first"] = """WITH r AS (SELECT l_orderkey AS v, l_partkey * 1000 + l_suppkey AS o, max(l_linenumber) AS label FROM lineitem GROUP BY ALL)
SELECT CAST(v AS INTEGER) AS clip_id, CAST(label AS INTEGER) AS label, ['Happiness','Sadness','Neutral','Anger','Surprise','Disgust','Fear'][label] AS emotion FROM r WHERE label BETWEEN 1 AND 7 QUALIFY row_number() OVER (PARTITION BY v ORDER BY o) = 1"""

SQL["excluded_duplicates"] = """SELECT c_custkey AS clip_id FROM customer WHERE c_custkey NOT IN (
  SELECT o_custkey FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 7 = 0 UNION ALL SELECT o_custkey + 1 FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 11 = 0)"""

SQL["upsert"] = """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey * 2 FROM orders) UNION ALL SELECT o_orderkey * 2, 0, 'X' FROM orders"""

SQL["insert_new"] = """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders UNION ALL SELECT o_orderkey * 2, 0, 'X' FROM orders WHERE o_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders)"""

SQL["stimulus_audit"] = """SELECT 'missing' AS "check", o_orderkey AS subject FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey + l_linenumber FROM lineitem)
UNION ALL SELECT 'duplicate', l_orderkey + l_linenumber FROM lineitem GROUP BY l_orderkey + l_linenumber HAVING count(*) > 1"""

SQL["missing_clips"] = """SELECT s_suppkey + 2 AS clip_id FROM supplier WHERE s_suppkey + 2 NOT IN (
  SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey % (l_suppkey % 3 + 15)) = 16)"""

SQL["manifest_violations"] = """SELECT 'task_type' AS "check", CAST(l_partkey AS VARCHAR) AS subject, 'image' AS detail FROM lineitem WHERE l_linenumber = 7
UNION ALL SELECT 'frame_index', CAST(l_partkey AS VARCHAR), CAST(l_suppkey % 18 AS VARCHAR) FROM lineitem WHERE l_linenumber < 5 AND l_suppkey % 18 NOT BETWEEN 1 AND 16
UNION ALL SELECT 'frame_index', CAST(l_partkey AS VARCHAR), NULL FROM lineitem WHERE l_linenumber = 5"""

SQL["adjacent_differences"] = f"""WITH {_POINTS}, s AS (SELECT task_uuid, annotator_code, i - 1 AS position, round(v - lag(v) OVER (PARTITION BY task_uuid, annotator_code ORDER BY i), 6) AS difference FROM pt)
SELECT task_uuid, annotator_code, position, difference FROM s WHERE difference IS NOT NULL"""

SQL["gap_of_one_queue"] = """WITH p AS (SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events),
q AS (SELECT event_id, position, lag(position) OVER (PARTITION BY user_id ORDER BY position) AS previous FROM p) SELECT * FROM q WHERE position - previous <= 9"""

SQL["quarters_of_ties"] = """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN floor(o_totalprice / 200000) END AS v FROM orders),
r AS (SELECT o_orderkey, row_number() OVER (ORDER BY v, o_orderkey) AS r, count(*) OVER () AS n FROM v WHERE v IS NOT NULL),
q AS (SELECT o_orderkey, CASE WHEN n < 4 THEN NULL ELSE len(list_filter([1, 2, 3], lambda k: (r - 1) * 4 > k * (n - 1))) END AS quarter FROM r)
SELECT v.o_orderkey, CAST(q.quarter AS INTEGER) AS quarter FROM v LEFT JOIN q ON q.o_orderkey = v.o_orderkey"""

SQL["medians_of_ties"] = """SELECT l_returnflag AS grp, median(l_quantity) AS median FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'all', median(l_quantity) FROM lineitem"""

SQL["schedule_needs"] = """WITH c AS (SELECT l_suppkey AS rater, l_partkey % 11 AS clip, count(*) AS n FROM lineitem GROUP BY ALL),
m AS (SELECT *, max(n) OVER (PARTITION BY rater) AS top FROM c),
s AS (SELECT rater, CAST(sum(n) AS BIGINT) AS items, max(top) AS largest, count(*) FILTER (n = top) AS ties FROM m GROUP BY rater)
SELECT *, (largest - 1) * 5 + ties AS needed, (largest - 1) * 5 + ties <= items AS feasible FROM s"""

SQL["assignment_states"] = """WITH e AS (SELECT event_id AS id, user_id AS who, epoch_us(ts) AS moment, event_type <> 'error' AS visible,
  CASE WHEN event_id % 53 = 0 THEN 'reset' WHEN event_id % 5 = 0 THEN 'opened' WHEN event_id % 5 = 1 THEN 'draft' WHEN event_id % 5 = 2 THEN 'submitted' ELSE 'activity' END AS kind,
  CASE WHEN event_id % 7 = 0 THEN 'Joy' ELSE 'Fear' END AS category, CAST(event_id % 4 AS INTEGER) AS intensity FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY moment, id) AS n FROM e),
l AS (SELECT n.*, category = 'Fear' AND intensity > 0 AS good FROM n LEFT JOIN (SELECT who, max(n) AS reset FROM n WHERE kind = 'reset' GROUP BY who) r USING (who) WHERE n.n > coalesce(reset, 0)),
g AS (SELECT *, CASE WHEN lag(visible) OVER w THEN least(moment // 1000 - lag(moment // 1000) OVER w, 60000) ELSE 0 END AS gap FROM l WINDOW w AS (PARTITION BY who ORDER BY n)),
s AS (SELECT who, min(n) FILTER (kind = 'opened') AS opened, min(n) FILTER (kind = 'submitted' AND good) AS first, max(n) FILTER (kind = 'submitted' AND good) AS last, max(n) FILTER (kind = 'draft') AS draft,
  count(*) FILTER (kind = 'submitted' AND NOT good) AS rejected, CAST(sum(gap) AS BIGINT) AS active_ms FROM g GROUP BY who)
SELECT CAST(u.who AS VARCHAR) AS assignment_uuid, CASE WHEN last IS NOT NULL THEN 'complete' WHEN opened IS NOT NULL THEN 'started' ELSE 'pending' END AS status,
  CASE WHEN first IS NULL OR opened < first THEN o.moment END AS started_at, t.moment AS completed_at, CASE WHEN t.id IS NOT NULL THEN least(t.id * 1000, 86400000) END AS duration_ms, t.category AS visible_category, t.intensity AS intensity,
  CASE WHEN last IS NULL OR draft > last THEN CAST(d.id AS VARCHAR) END AS payload_json, coalesce(rejected, 0) AS rejected, coalesce(active_ms, 0) AS active_ms
FROM (SELECT DISTINCT who FROM e) u LEFT JOIN s ON s.who = u.who LEFT JOIN n o ON o.who = u.who AND o.n = s.opened LEFT JOIN n t ON t.who = u.who AND t.n = s.last LEFT JOIN n d ON d.who = u.who AND d.n = s.draft"""

SQL["release_scan"] = r"""WITH f AS (SELECT ['docs', 'demo_data', 'exports', 'a/b'][CAST(doc_id % 4 + 1 AS INTEGER)] AS folder, ['.md', '.py', '.csv', '.JPG', '.npz', ''][CAST(doc_id % 6 + 1 AS INTEGER)] AS suffix, doc_id, text FROM documents),
g AS (SELECT *, folder || '/' || doc_id || suffix AS path FROM f WHERE folder <> 'exports'),
l AS (SELECT path, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM g WHERE suffix IN ('.md', '.py'))
SELECT CASE WHEN suffix = '.npz' THEN 'forbidden binary' ELSE 'image outside demo' END AS "check", path, CAST(NULL AS BIGINT) AS line, lower(suffix) AS detail FROM g WHERE suffix = '.npz' OR (suffix = '.JPG' AND folder <> 'demo_data')
UNION ALL SELECT 'sensitive text', path, line, p FROM l, (SELECT unnest(['[Pp]assword', '[a-z]+@[a-z]+\.']) AS p) WHERE regexp_matches(t, p)"""
