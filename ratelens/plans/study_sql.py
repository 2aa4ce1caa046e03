"""DuckDB SQL of the queries on whole studies."""

from __future__ import annotations

from .sql import _AGREED, _CATEGORY, _DESCRIBED, _DISAGREE, _FRAMES, _POINTS, _described

#: The study without faults: e (frame tasks), c (clip tasks and who rates them), a (assignments), r (clip ratings).
_STUDY = f"""{_FRAMES},
e AS (SELECT task_uuid AS id, 'f' || task_uuid AS task, 'f' || task_uuid || '-R' || task_uuid % 3 AS work, 'R' || task_uuid % 3 AS rater, * EXCLUDE (task_uuid),
  CASE repeat_kind WHEN 'none' THEN 'primary' WHEN 'second_rater' THEN 'second' ELSE 'hidden_repeat' END AS role,
  CASE task_uuid % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'started' ELSE 'complete' END AS status FROM f),
c AS (SELECT vec_id AS id, 'c' || vec_id AS task, ['test', 'train_alignment', 'calibration'][CAST(label % 3 + 1 AS INTEGER)] AS split, k, 'R' || (vec_id + k) % 3 AS rater, 'c' || vec_id || '-R' || (vec_id + k) % 3 AS work,
  ['primary', 'second', 'adjudication'][k] AS role, CASE WHEN k = 2 AND vec_id % 7 = 3 THEN 'started' ELSE 'complete' END AS status FROM embeddings, (SELECT unnest([1, 2, 3]) AS k) WHERE k < 3 OR vec_id % 4 = 0),
a AS (SELECT work, task, rater, role, CAST(id AS INTEGER) AS place, status, id * 10 AS ms, id, 0 AS k FROM e UNION ALL SELECT work, task, rater, role, CAST(id * 3 + k AS INTEGER), status, id * 1000, id, k FROM c)"""

_NEEDED = f"{_POINTS}, {_DESCRIBED}, {_DISAGREE}, need AS (SELECT 'c' || task_uuid AS task, task_uuid AS id, reasons FROM dis WHERE reasons <> '' AND task_uuid % 7 <> 3)"

SQL: dict[str, str] = {}

SQL["constraint_violations"] = f"""WITH {_STUDY}, v AS (
  SELECT 'study_meta.primary_key' AS "check", unnest(['design_version', 'test_clips', 'minimum_clip_gap']) AS subject, '2' AS detail
  UNION ALL SELECT 'frame_ratings.primary_key', 'lost', CAST(count(*) AS VARCHAR) FROM e WHERE status = 'complete' AND id % 61 = 0 HAVING count(*) > 1
  UNION ALL SELECT 'annotators.active', 'R4', '2' FROM region WHERE r_regionkey = 4
  UNION ALL SELECT 'tasks.repeat_kind', task, 'again' FROM e WHERE id % 101 = 0
  UNION ALL SELECT 'tasks.frame_index', task, '17' FROM e WHERE id % 89 = 0
  UNION ALL SELECT 'tasks.frame_needs_index', task, 'frame' FROM e WHERE id % 97 = 0 AND id % 89 <> 0
  UNION ALL SELECT 'tasks.source_task_uuid', task, 'gone' FROM e WHERE id % 83 = 0
  UNION ALL SELECT 'assignments.role', work, 'guest' FROM e WHERE id % 79 = 0
  UNION ALL SELECT 'assignments.annotator_code', work, 'R9' FROM e WHERE id % 73 = 0
  UNION ALL SELECT 'assignments.unique', task || '|R' || (id + 1) % 3 || '|primary', '2' FROM c WHERE k = 2 AND id % 11 = 0
  UNION ALL SELECT 'frame_ratings.visible_category', CASE WHEN id % 61 = 0 THEN 'lost' ELSE work END, 'Boredom' FROM e WHERE status = 'complete' AND id % 67 = 0
  UNION ALL SELECT 'frame_ratings.intensity', CASE WHEN id % 61 = 0 THEN 'lost' ELSE work END, '7' FROM e WHERE status = 'complete' AND id % 71 = 0
  UNION ALL SELECT 'frame_ratings.assignment_uuid', 'lost', 'lost' FROM e WHERE status = 'complete' AND id % 61 = 0
  UNION ALL SELECT 'drafts.not_null', work, 'payload_json' FROM e WHERE id % 4 = 1 AND id % 59 = 0
  UNION ALL SELECT 'clip_ratings.speaking', work, '2' FROM c WHERE status = 'complete' AND id % 13 = 0
  UNION ALL SELECT 'adjudication_cases.status', 'c' || vec_id, 'lost' FROM embeddings WHERE vec_id % 8 = 0 AND vec_id % 5 = 0)
SELECT "check", subject, detail FROM v"""

SQL["study_violations"] = f"""WITH {_STUDY}, {_NEEDED},
p AS (SELECT CASE WHEN id % 73 = 0 THEN 'R9' ELSE rater END AS who, clip_id, row_number() OVER (PARTITION BY CASE WHEN id % 73 = 0 THEN 'R9' ELSE rater END ORDER BY id) AS n FROM e),
g AS (SELECT *, n - lag(n) OVER (PARTITION BY who, clip_id ORDER BY n) AS d FROM p),
w AS (SELECT who, clip_id FROM g WHERE d <= 3 QUALIFY row_number() OVER (PARTITION BY who ORDER BY n) = 1),
b AS (SELECT count(*) AS n FROM e WHERE repeat_kind = 'none' AND id % 101 <> 0)
SELECT 'base_frame_tasks' AS "check", 'tasks' AS subject, CAST(n AS VARCHAR) AS detail FROM b WHERE n <> 7 * 16
UNION ALL SELECT 'clip_gap', who, CAST(clip_id AS VARCHAR) FROM w
UNION ALL SELECT 'curve', work, NULL FROM c WHERE status = 'complete' AND id % 28 IN (3, 10)
UNION ALL SELECT 'incomplete', 'assignments', CAST(count(*) AS VARCHAR) FROM a WHERE status <> 'complete' HAVING count(*) > 0
UNION ALL SELECT 'unresolved_disagreement', n.task, reasons FROM need n JOIN c ON c.id = n.id AND k = 1 WHERE split <> 'calibration' AND n.id % 4 <> 0"""

_VALID = """CASE WHEN id % 61 = 0 THEN 'assignment' WHEN id % 11 = 0 THEN 'category' WHEN id % 13 = 0 THEN 'intensity' WHEN category IN ('Neutral', 'Face not visible') AND intensity <> 0 THEN 'must_be_zero'
  WHEN category NOT IN ('Neutral', 'Unclear', 'Face not visible') AND intensity < 1 THEN 'must_be_positive' END"""

SQL["save_ratings"] = f"""WITH {_STUDY}, s AS (SELECT *, {_VALID} AS error, id % 5 = 0 AND id % 61 <> 0 AS again FROM e)
SELECT 'assignment' AS kind, work AS id, CASE WHEN again THEN 'complete/5' WHEN error IS NULL THEN 'complete/' || greatest(0, least((id - 100) * 100000, 86400000)) ELSE status || '/' || id * 10 END AS value FROM s
UNION ALL SELECT 'rating', work, CASE WHEN again THEN 'Mixed/3' ELSE category || '/' || intensity END FROM s WHERE again OR error IS NULL OR status = 'complete'
UNION ALL SELECT 'draft', work, '' FROM s WHERE id % 4 = 1 AND NOT again AND error IS NOT NULL
UNION ALL SELECT 'rejected', CASE WHEN id % 61 = 0 THEN 'lost' ELSE work END, error FROM s WHERE error IS NOT NULL
UNION ALL SELECT 'rejected', 'lost', 'assignment' FROM s WHERE id % 5 = 0 AND id % 61 = 0"""

SQL["merged_study"] = f"""WITH {_STUDY}, m AS (SELECT *, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 3 END AS n FROM e)
SELECT 'assignment' AS kind, work AS id, CASE WHEN n IS NULL THEN status || '/' || id * 10 ELSE 'complete/' || id * 20 + n END AS value FROM m
UNION ALL SELECT 'assignment', work, status || '/' || id * 1000 FROM c
UNION ALL SELECT 'rating', work, CASE WHEN n IS NULL THEN category || '/' || intensity ELSE {_CATEGORY}[CAST((id + n) % 10 + 1 AS INTEGER)] || '/' || n END FROM m WHERE n IS NOT NULL OR status = 'complete'
UNION ALL SELECT 'log', 'B0', '1'
UNION ALL SELECT 'log', 'B' || b, CAST((SELECT count(*) FROM e WHERE id % 3 = least(b, 2)) AS VARCHAR) FROM (SELECT unnest([1, 2, 3]) AS b)"""

SQL["merge_check"] = f"""WITH {_STUDY}
SELECT CASE WHEN work[2:] LIKE '%7-%' THEN work || 'x' ELSE work END AS assignment_uuid, CASE WHEN work[2:] LIKE '%7-%' THEN 'unknown' ELSE 'mismatch' END AS problem FROM a WHERE work[2:] LIKE '%7-%' OR work[2:] LIKE '%3-%'"""

SQL["rater_bundle"] = f"""WITH {_STUDY}
SELECT 'annotators' AS kind, 'R1' AS id, '' AS value
UNION ALL SELECT 'study_meta', k, v FROM (SELECT unnest(['design_version', 'test_clips', 'minimum_clip_gap', 'bundle_annotator']) AS k, unnest(['1', '7', '3', 'R1']) AS v)
UNION ALL SELECT 'tasks', task, '' FROM e UNION ALL SELECT 'tasks', 'c' || vec_id, '' FROM embeddings
UNION ALL SELECT 'assignments', work, '' FROM a WHERE rater = 'R1'
UNION ALL SELECT 'frame_ratings', work, '' FROM e WHERE rater = 'R1' AND status = 'complete'
UNION ALL SELECT 'clip_ratings', work, '' FROM c WHERE rater = 'R1' AND status = 'complete'
UNION ALL SELECT 'drafts', work, '' FROM e WHERE rater = 'R1' AND id % 4 = 1"""

SQL["export_results"] = f"""WITH {_STUDY}, d AS (SELECT * FROM a WHERE rater = 'R1' AND status = 'complete')
SELECT 'assignments' AS kind, work AS id, '' AS value FROM d UNION ALL SELECT 'frame_ratings', work, '' FROM d WHERE k = 0 UNION ALL SELECT 'clip_ratings', work, '' FROM d WHERE k > 0
UNION ALL SELECT 'bundle', substr(sha256('R1|' || string_agg(work, '|' ORDER BY work)), 1, 20), 'R1/1/' || count(*) FROM d"""

_WANTED = "n AS (SELECT n.task, n.id, n.reasons, 'R' || n.id % 3 AS who, n.id % 4 = 0 AS assigned FROM need n JOIN c ON c.id = n.id AND k = 1 WHERE split <> 'calibration')"

SQL["new_adjudications"] = f"""WITH {_STUDY}, {_NEEDED}, {_WANTED},
l AS (SELECT rater, max(place) AS last FROM a GROUP BY rater),
q AS (SELECT n.*, CASE WHEN NOT assigned THEN last + row_number() OVER (PARTITION BY who, assigned ORDER BY task) END AS place FROM n JOIN l ON l.rater = n.who)
SELECT coalesce(q.task, o.task) AS task_uuid, coalesce(q.reasons, 'category') AS reasons, coalesce(o.status, 'pending') AS status, who AS annotator_code, CAST(place AS INTEGER) AS queue_position, assigned
FROM q FULL JOIN (SELECT 'c' || vec_id AS task, CASE WHEN vec_id % 16 = 0 THEN 'complete' ELSE 'pending' END AS status FROM embeddings WHERE vec_id % 8 = 0) o ON o.task = q.task"""

SQL["unassignable_adjudications"] = f"""WITH {_STUDY}, {_NEEDED}, {_WANTED}, l AS (SELECT rater, max(place) AS last FROM a GROUP BY rater)
SELECT task AS task_uuid, CASE WHEN who <> 'R2' THEN who END AS annotator_code, CAST(CASE WHEN who <> 'R2' AND NOT assigned THEN last + row_number() OVER (PARTITION BY who, assigned ORDER BY task) END AS INTEGER) AS queue_position,
  CASE WHEN who = 'R2' THEN 'no unique third rater' END AS problem FROM n JOIN l ON l.rater = n.who"""

_LIST = "'[' || string_agg(CAST({0} AS VARCHAR), ', ' ORDER BY i) || ']'"

SQL["consensus_export"] = f"""WITH {_POINTS}, {_DESCRIBED}, {_DISAGREE}, {_AGREED}, {_described("cpt", "task_uuid").replace("described AS", "final AS").replace(" d_", " e_").replace("\nd_", "\ne_")},
s AS (SELECT task_uuid, i, v, v - lag(v) OVER (PARTITION BY task_uuid ORDER BY i) AS d FROM cpt)
SELECT g.task_uuid AS clip_id, 'test' AS split, 3 AS n_ratings, g.category AS dominant_category, {_LIST.format("s.v")} AS intensities_json, '[' || string_agg(CAST(s.d AS VARCHAR), ', ' ORDER BY i) FILTER (i > 0) || ']' AS adjacent_differences_json, any_value(f.peak_type) AS peak_type
FROM agreed g JOIN s ON s.task_uuid = g.task_uuid JOIN final f ON f.task_uuid = g.task_uuid GROUP BY g.task_uuid, g.category"""

SQL["adjudication_export"] = f"""WITH {_POINTS}, {_DESCRIBED}, {_DISAGREE}, {_AGREED},
t AS (SELECT task_uuid, {_LIST.format("CAST(v AS INTEGER)")} AS said FROM pt WHERE annotator_code = 'R03' GROUP BY task_uuid), m AS (SELECT task_uuid, {_LIST.format("v")} AS last FROM cpt GROUP BY task_uuid)
SELECT task_uuid AS clip_id, 'test' AS split, reasons, 'R03' AS third_annotator, third AS third_category, said AS third_intensities_json, category AS final_category, last AS final_intensities_json, 'complete' AS status
FROM agreed JOIN t USING (task_uuid) JOIN m USING (task_uuid) WHERE needed"""

SQL["study_design"] = """WITH n AS (SELECT count(*) FILTER (vec_id % 2 = 0) AS t, count(*) FILTER (vec_id % 2 = 1) AS r FROM embeddings),
x AS (SELECT t, r, 16 * t AS base, CAST(round_even(16 * t * 0.1, 0) AS BIGINT) AS second, CAST(round_even(16 * t * 0.02, 0) AS BIGINT) AS hidden FROM n)
SELECT 'test' AS split, 'frame' AS task_type, unnest(['primary', 'second', 'hidden_repeat']) AS role, unnest([base, second, hidden]) AS n FROM x
UNION ALL SELECT unnest(['test', 'test', 'train_alignment', 'train_alignment']), 'clip', unnest(['primary', 'second', 'primary', 'second']), unnest([t, t, r, r]) FROM x
UNION ALL SELECT 'all', 'queue', 'whole', base + second + hidden + 2 * t + 2 * r FROM x
UNION ALL SELECT 'all', 'frame', 'too near', 0"""

SQL["gap_schedule"] = """SELECT l_suppkey AS annotator_code, count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber, l_partkey)) AS items, count(*) AS "last", CAST(sum(CAST('0x' || substr(md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey), 1, 8) AS BIGINT)) AS BIGINT) AS digest, false AS near FROM lineitem GROUP BY l_suppkey"""

SQL["complete_clips"] = "SELECT l_suppkey AS clip_id FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey % (l_suppkey % 7 + 10)) = 16"

SQL["clip_targets"] = f"""WITH {_STUDY}
SELECT DISTINCT rater AS annotator_code, CAST(clip_id AS INTEGER) AS clip_id, CAST(id % 16 + 1 AS INTEGER) AS frame_index FROM e UNION SELECT rater, CAST(id AS INTEGER), 1 FROM c"""

SQL["logins"] = "SELECT n_nationkey, 'R' || n_regionkey AS code FROM nation WHERE n_regionkey < 3"

SQL["opened_work"] = f"""WITH {_STUDY}
SELECT work AS assignment_uuid, CASE WHEN status = 'pending' AND place % 3 = 0 THEN 'started' ELSE status END AS status, status = 'pending' AND place % 3 = 0 AS opened FROM a"""

SQL["open_drafts"] = f"""WITH {_STUDY}
SELECT work AS assignment_uuid, CASE WHEN CAST(place AS VARCHAR) LIKE '%7' THEN '{{}}' ELSE place || '/2' END AS payload_json FROM a
WHERE status <> 'complete' AND (CAST(place AS VARCHAR) NOT LIKE '%7' OR (k = 0 AND id % 4 = 1))"""

SQL["flags"] = "SELECT doc_id, CASE WHEN toxic <> 0 THEN 1 ELSE 0 END AS toxic, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS good, 16 AS points FROM labels"

SQL["times"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 1 THEN strftime(o_orderdate, '%Y%m%d%H%M%S') END AS at FROM orders"

SQL["rating_problems"] = f"""WITH {_STUDY}, p AS (
  SELECT CASE WHEN id % 61 = 0 THEN 'lost' ELSE work END AS assignment_uuid, CASE WHEN id % 61 = 0 THEN 'unknown' WHEN id % 67 = 0 THEN 'category' WHEN id % 71 = 0 THEN 'intensity' END AS problem FROM e WHERE status = 'complete')
SELECT assignment_uuid, 'frame_ratings' AS kind, problem FROM p WHERE problem IS NOT NULL
UNION ALL SELECT work, 'clip_ratings', 'flag' FROM c WHERE status = 'complete' AND id % 13 = 0"""

SQL["raw_clips"] = f"""WITH {_STUDY}, {_POINTS},
w AS (SELECT task_uuid, CAST(annotator_code[3:] AS INTEGER) AS k, category, list(CAST(v AS INTEGER) ORDER BY i) AS l FROM pt GROUP BY ALL)
SELECT c.rater AS annotator_code, c.role, c.id * 1000 AS duration_ms, CAST(c.id AS INTEGER) AS clip_id, c.split, w.category AS dominant_category, '[' || array_to_string(l, ', ') || ']' AS intensities_json, 0 AS occlusion, 0 AS speaking, 0 AS abrupt_change, 1 AS subject_switch,
  CAST(1700000000 AS BIGINT) AS submitted_at, {", ".join(f"l[{i}] AS intensity_{i}" for i in range(1, 17))} FROM c JOIN w ON w.task_uuid = c.id AND w.k = c.k WHERE c.status = 'complete'"""

SQL["raw_frames"] = f"""WITH {_STUDY}
SELECT task AS task_uuid, 'f' || source_task_uuid AS source_task_uuid, rater AS annotator_code, role, id * 10 AS duration_ms, CAST(clip_id AS INTEGER) AS clip_id, CAST(id % 16 + 1 AS INTEGER) AS frame, repeat_kind, category AS visible_category, intensity, 0 AS submitted_at FROM e WHERE status = 'complete'"""

SQL["calibration_queue"] = f"""WITH {_STUDY},
m AS (SELECT CAST(row_number() OVER (ORDER BY n_name) AS INTEGER) AS place, CASE WHEN n_nationkey % 2 = 0 THEN 'frame/' || n_nationkey || '/' || (n_nationkey % 16 + 1) ELSE 'clip/' || n_nationkey END AS task FROM nation)
SELECT rater AS annotator_code, task, CAST(place + (SELECT count(*) FROM nation) AS INTEGER) AS queue_position FROM a UNION ALL SELECT 'R' || r, task, place FROM m, (SELECT unnest([0, 1, 2]) AS r)"""

SQL["calibration_manifest"] = """WITH d AS (SELECT doc_id, lang, n_chars, doc_id % 2 = 0 AS inside FROM documents),
o AS (SELECT *, count(*) FILTER (NOT inside) OVER (PARTITION BY lang) AS outside FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM o WHERE outside < 5 OR NOT inside),
p AS (SELECT doc_id, lang, CASE WHEN r <= 3 THEN 'clear' ELSE 'category_boundary' END AS profile FROM r WHERE n >= 5 AND (r <= 3 OR r > n - 2)),
f AS (SELECT *, [2, 6, 11, 15][CAST((row_number() OVER (PARTITION BY lang ORDER BY profile, doc_id) - 1) % 4 + 1 AS INTEGER)] AS frame FROM p),
b AS (SELECT 0 AS phase, doc_id, lang, profile, 'frame' AS task_type, frame FROM f UNION ALL SELECT 1, doc_id, lang, profile, 'clip', NULL FROM f)
SELECT CAST(row_number() OVER (ORDER BY phase, lang, profile, doc_id) AS INTEGER) AS place, doc_id AS clip_id, task_type, frame AS frame_index FROM b"""
