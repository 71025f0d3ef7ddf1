"""Queries of merging and evaluation, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.operators import evaluate as ev
from reelgrid.operators import merge
from reelgrid.session import table

#: Classes with a scale of their own.
OWN = ("Gravel road",)
BEST = """best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, uuid ORDER BY (coalesce(n_frames, 0) > 0) DESC, shard_no NULLS FIRST, loaded_at NULLS FIRST) AS rn FROM clip_results) WHERE rn = 1)"""
LAB = """lab AS (
  SELECT * EXCLUDE (uuid, rn) FROM (SELECT *, lower(trim(uuid)) AS u, row_number() OVER (PARTITION BY lower(trim(uuid)) ORDER BY rev DESC, updated_at DESC) AS rn FROM labels_store) WHERE rn = 1 AND class_list IS NOT NULL)"""
PAIRS = f"""{BEST}, {LAB}, pairs AS (
  SELECT run_id, u AS uuid, list_sort(list_distinct(class_list)) AS gt,
    CASE WHEN trim(coalesce(b.classes, '')) = '' THEN [] ELSE list_sort(list_distinct(string_split(b.classes, '|'))) END AS pred,
    b.group_scores AS packed, lab.group_scores AS gs, weather, illumination, precipitation, road_surface, atmospheric_obscurants
  FROM best b JOIN lab ON lower(trim(b.uuid)) = u),
grp AS (SELECT class_name, group_name, is_unknown FROM taxonomy)"""
PARTS = """parts AS (SELECT run_id, uuid, unnest(string_split(coalesce(packed, ''), '|')) AS part, unnest(range(len(string_split(coalesce(packed, ''), '|')))) AS i FROM pairs),
kv AS (
  SELECT run_id, uuid, trim(regexp_extract(part, '^(.*)=([^=]*)$', 1)) AS name, i,
    CASE WHEN regexp_full_match(trim(regexp_extract(part, '^(.*)=([^=]*)$', 2)), '[+-]?[0-9]+') THEN trim(regexp_extract(part, '^(.*)=([^=]*)$', 2))::INT END AS v
  FROM parts),
ps AS (SELECT run_id, uuid, name, arg_max(v, i) AS p FROM kv WHERE name <> '' AND v IS NOT NULL GROUP BY ALL),
gt AS (SELECT run_id, uuid, e.key AS name, e.value AS t FROM (SELECT run_id, uuid, unnest(map_entries(gs)) AS e FROM pairs) WHERE e.value IS NOT NULL AND e.value <> -1)"""
SCORES = "sp AS (SELECT run_id, uuid, name, t, p FROM gt JOIN ps USING (run_id, uuid, name))"
AXES = "ax AS (" + " UNION ALL ".join(f"SELECT run_id, uuid, '{a}' AS name, weather['{a}'] AS t, {a} AS p FROM pairs WHERE weather['{a}'] IS NOT NULL AND {a} IS NOT NULL" for a in ev.AXES) + ")"
PRF = "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"
_FLAGS = "count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return ev.matched(table(spark, sf, "clip_results"), table(spark, sf, "labels_store"))


def _tax(spark: SparkSession, sf: str) -> ev.Taxonomy:
    return ev.Taxonomy.of(table(spark, sf, "taxonomy"))


def _with_tax(f, change=None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        tax = _tax(spark, sf)
        pairs = _pairs(spark, sf)
        return f(change(pairs, tax) if change else pairs, tax)

    return run


def _scores(f, of=ev.score_pairs):
    return lambda spark, sf: f(of(_pairs(spark, sf)))


def _merged(spark: SparkSession, sf: str, how) -> DataFrame:
    df = table(spark, sf, "clip_results").select("run_id", "shard_no", "loaded_at", "uuid", "n_frames", "verdict", "classes")
    return how(df)




def _order() -> list:
    return [F.col("shard_no"), F.col("loaded_at")]


QUERIES = {
    "merge_keep_best": partial(_merged, how=lambda df: merge.keep_best(df, ["run_id", "uuid"], F.col("n_frames") > 0, _order())),
    "dedup_keep_first": partial(_merged, how=lambda df: merge.keep_first(df, ["run_id", "uuid"], _order())),
    "dedup_keep_last": lambda s, d: merge.keep_last(table(s, d, "recheck_answers").select("run_id", "uuid", "class_name", "shard_no", "answered_at", "answer_id", "present", "score"), ["run_id", "uuid", "class_name"], [F.col("shard_no"), F.col("answered_at"), F.col("answer_id")]),
    "resume_scan": partial(_merged, how=lambda df: merge.resume_scan(df, ["run_id", "shard_no"], ["run_id", "uuid"], _order())),
    "overlap_report": partial(_merged, how=lambda df: merge.overlap(df, ["run_id", "uuid"], ["run_id"])),
    "verdict_metrics": _with_tax(ev.verdict_metrics),
    "clip_f1": lambda s, d: ev.clip_f1(_pairs(s, d)),
    "class_prf": _with_tax(ev.class_prf),
    "micro_macro_f1": _with_tax(ev.micro_macro),
    "class_lists": lambda s, d: ev.class_lists(_pairs(s, d)),
    "group_restricted_prf": _with_tax(ev.class_prf, lambda p, t: ev.restrict_to_group(p, t, "Dynamic object")),
    "unknown_dropped_verdict": _with_tax(ev.verdict_metrics, ev.drop_unknown),
    "unknown_classes": _with_tax(lambda p, t: ev.class_counts(p, t, unknown=True)),
    "ordinal_block": _scores(ev.ordinal_block),
    "pooled_ordinal": _scores(lambda s: ev.ordinal_block(s.withColumns({"uuid": F.concat_ws("/", "uuid", "name"), "name": F.lit("ALL")}))),
    "confusion": _scores(ev.confusion),
    "split_scores": lambda s, d: ev.ordinal_block(ev.split_scores(ev.drop_unknown(ev.matched(table(s, d, "clip_results"), table(s, d, "labels_store"), fields=True), _tax(s, d)), _tax(s, d), OWN)),
    "restriction_counts": _with_tax(lambda p, t: ev.restriction_counts(p, t, "Dynamic object")),
    "class_table": _with_tax(lambda p, t: ev.class_table(ev.class_prf(p, t), t)),
    "conflicts": _with_tax(ev.conflicts),
    "axis_summary": _scores(ev.axis_summary, ev.axis_pairs),
    "axis_ordinal": _scores(ev.ordinal_block, ev.axis_pairs),
    "name_drift": _with_tax(ev.name_drift),
    "missing_clips": lambda s, d: ev.missing_clips(table(s, d, "clip_results"), table(s, d, "labels_store")),
}

_MERGE_COLS = "run_id, shard_no, loaded_at, uuid, n_frames, verdict, classes"
_SCOPED = """sc AS (
  SELECT run_id, 'All' AS scope, len(gt) > 0 AS t, len(pred) > 0 AS p FROM {0}
  UNION ALL
  SELECT run_id, group_name, len(list_intersect(gt, cs)) > 0, len(list_intersect(pred, cs)) > 0
  FROM {0}, (SELECT group_name, list(class_name) AS cs FROM grp GROUP BY group_name))"""
_VERDICT = f"""SELECT run_id, scope, tp, fp, fn, tn, {PRF}, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity
FROM (SELECT run_id, scope, {_FLAGS}, count(*) FILTER (NOT t AND NOT p) AS tn FROM sc GROUP BY ALL) WHERE scope = 'All' OR tp + fp + fn > 0"""


def _classes(gt: str, where: str) -> str:
    return f"""cc AS (
  SELECT run_id, c AS class_name, list_contains({gt}, c) AS t, list_contains(pred, c) AS p FROM (SELECT *, unnest(list_distinct(list_concat({gt}, pred))) AS c FROM pairs)
  UNION ALL SELECT run_id, class_name, false, false FROM (SELECT DISTINCT run_id FROM pairs), grp),
counts AS (
  SELECT run_id, cc.class_name, {_FLAGS} FROM cc LEFT JOIN grp USING (class_name) WHERE {where} GROUP BY ALL)"""


_ORDINAL = """SELECT s.run_id, s.name, count(*) AS n, avg((t - p) * (t - p)) AS mse, avg((t = p)::INT) AS exact, avg((abs(t - p) <= 1)::INT) AS within_one,
  avg((t = p)::INT) FILTER (t <> 0) AS exact_nz, avg((abs(t - p) <= 1)::INT) FILTER (t <> 0) AS within_one_nz, any_value(mode) AS mode,
  avg((t - mode) * (t - mode)) AS base_mse, avg((t = mode)::INT) AS base_exact, avg((t - p) * (t - p)) < avg((t - mode) * (t - mode)) AS beats
FROM {0} s JOIN (
  SELECT run_id, name, t AS mode FROM (SELECT run_id, name, t, row_number() OVER (PARTITION BY run_id, name ORDER BY count(*) DESC, min(uuid)) AS r FROM {0} GROUP BY run_id, name, t) WHERE r = 1) m
ON s.run_id = m.run_id AND s.name = m.name GROUP BY s.run_id, s.name"""

SQL = {
    "merge_keep_best": f"WITH {BEST} SELECT {_MERGE_COLS} FROM best",
    "dedup_keep_first": f"SELECT {_MERGE_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY run_id, uuid ORDER BY shard_no NULLS FIRST, loaded_at NULLS FIRST) AS rn FROM clip_results) WHERE rn = 1",
    "dedup_keep_last": "SELECT run_id, uuid, class_name, shard_no, answered_at, answer_id, present, score FROM (SELECT *, row_number() OVER (PARTITION BY run_id, uuid, class_name ORDER BY shard_no DESC NULLS LAST, answered_at DESC NULLS LAST, answer_id DESC) AS rn FROM recheck_answers) WHERE rn = 1",
    "resume_scan": """WITH d AS (SELECT *, trim(coalesce(uuid, '')) <> '' AND coalesce(n_frames, 0) > 0 AS done FROM clip_results),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, uuid, done ORDER BY shard_no NULLS FIRST, loaded_at NULLS FIRST) AS rn FROM d)
SELECT run_id, shard_no, count(*) AS n_rows, count(*) FILTER (done AND rn = 1) AS keep, count(*) FILTER (NOT done) AS drop, count(*) FILTER (done AND rn > 1) AS dup FROM r GROUP BY ALL""",
    "overlap_report": "SELECT run_id, count(*) AS n_rows, count(DISTINCT uuid) AS n_keys, count(*) - count(DISTINCT uuid) AS n_duplicates FROM clip_results GROUP BY run_id",
    "verdict_metrics": f"WITH {PAIRS}, {_SCOPED.format('pairs')} {_VERDICT}",
    "clip_f1": f"""WITH {PAIRS}, f AS (SELECT run_id, len(gt) > 0 AS s, CASE WHEN len(gt) + len(pred) = 0 THEN 1.0 ELSE 2 * len(list_intersect(gt, pred)) / (len(gt) + len(pred)) END AS f FROM pairs)
SELECT run_id, count(*) AS n, avg(f) AS f1, count(*) FILTER (s) AS n_special, avg(f) FILTER (s) AS f1_special FROM f GROUP BY run_id""",
    "class_prf": f"WITH {PAIRS}, {_classes('gt', 'NOT coalesce(is_unknown, false)')} SELECT *, tp + fn AS support, {PRF} FROM counts",
    "micro_macro_f1": f"WITH {PAIRS}, {_classes('gt', 'NOT coalesce(is_unknown, false)')}, s AS (SELECT *, {PRF} FROM counts) SELECT run_id, coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0) AS micro_f1, avg(f1) FILTER (tp + fn >= 3) AS macro_f1, count(*) FILTER (tp + fn >= 3) AS n_classes FROM s GROUP BY run_id",
    "class_lists": f"WITH {PAIRS} SELECT run_id, c AS class_name, CASE WHEN list_contains(gt, c) AND list_contains(pred, c) THEN 'TP' WHEN list_contains(pred, c) THEN 'FP' ELSE 'FN' END AS kind, uuid FROM (SELECT *, unnest(list_distinct(list_concat(gt, pred))) AS c FROM pairs)",
    "group_restricted_prf": f"WITH {PAIRS}, {_classes(chr(39).join(['list_intersect(gt, (SELECT list(class_name) FROM grp WHERE group_name = ', 'Dynamic object', '))']), 'NOT coalesce(is_unknown, false)')} SELECT *, tp + fn AS support, {PRF} FROM counts",
    "unknown_dropped_verdict": f"""WITH {PAIRS}, u AS (SELECT list(class_name) AS us FROM grp WHERE is_unknown),
dropped AS (SELECT run_id, list_filter(gt, lambda c: NOT list_contains(us, c)) AS gt, list_filter(pred, lambda c: NOT list_contains(us, c)) AS pred FROM pairs, u), {_SCOPED.format("dropped")} {_VERDICT}""",
    "unknown_classes": f"WITH {PAIRS}, {_classes('gt', 'is_unknown')} SELECT *, tp + fn AS support FROM counts",
    "ordinal_block": f"WITH {PAIRS}, {PARTS}, {SCORES} {_ORDINAL.format('sp')}",
    "pooled_ordinal": f"WITH {PAIRS}, {PARTS}, {SCORES}, al AS (SELECT run_id, uuid || '/' || name AS uuid, 'ALL' AS name, t, p FROM sp) {_ORDINAL.format('al')}",
    "confusion": f"""WITH {PAIRS}, {PARTS}, {SCORES}, g AS (SELECT * FROM (SELECT DISTINCT run_id, name FROM sp), (SELECT unnest(range(5)) AS t), (SELECT unnest(range(5)) AS p)),
c AS (SELECT g.run_id, g.name, g.t::INT AS t, g.p::INT AS p, count(sp.uuid) AS n FROM g LEFT JOIN sp ON g.run_id = sp.run_id AND g.name = sp.name AND g.t = sp.t AND g.p = sp.p GROUP BY ALL)
SELECT *, (sum(n) OVER w)::BIGINT AS total, (sum(CASE WHEN t = p THEN n ELSE 0 END) OVER w) / nullif(sum(n) OVER w, 0) AS acc, (sum(CASE WHEN abs(t - p) <= 1 THEN n ELSE 0 END) OVER w) / nullif(sum(n) OVER w, 0) AS acc_within_one FROM c WINDOW w AS (PARTITION BY run_id, name, t)""",
    "split_scores": f"""WITH {BEST}, {LAB}, pr AS (
  SELECT run_id, u AS uuid, list_distinct(class_list) AS gt, CASE WHEN trim(coalesce(b.classes, '')) = '' THEN [] ELSE list_distinct(string_split(b.classes, '|')) END AS pred,
    b.group_scores AS packed, b.field_scores AS fields, coalesce(b.score_reason, '') AS why, lab.group_scores AS gs, CASE WHEN has_class_scores THEN lab.classes END AS cs
  FROM best b JOIN lab ON lower(trim(b.uuid)) = u),
c AS (SELECT list(class_name) FILTER (group_name = 'Driving environment' AND NOT is_unknown AND class_name <> 'Gravel road') AS rest, list(class_name) FILTER (group_name = 'Driving environment' AND is_unknown) AS unk, list(class_name) FILTER (group_name = 'Driving environment') AS every FROM taxonomy),
cell AS (SELECT run_id, uuid, 'g' AS what, unnest(string_split(coalesce(packed, ''), '|')) AS part, unnest(range(len(string_split(coalesce(packed, ''), '|')))) AS i FROM pr
  UNION ALL SELECT run_id, uuid, 'f', unnest(string_split(fields, '|')), unnest(range(len(string_split(fields, '|')))) FROM pr WHERE fields IS NOT NULL),
kv AS (SELECT run_id, uuid, what, trim(regexp_extract(part, '^(.*)=([^=]*)$', 1)) AS k, i, CASE WHEN regexp_full_match(trim(regexp_extract(part, '^(.*)=([^=]*)$', 2)), '[+-]?[0-9]+') THEN trim(regexp_extract(part, '^(.*)=([^=]*)$', 2))::INT END AS v FROM cell),
val AS (SELECT run_id, uuid, what, k, arg_max(v, i) AS v FROM kv WHERE k <> '' AND v IS NOT NULL GROUP BY ALL),
v3 AS (SELECT run_id, uuid, max(v) FILTER (what = 'g' AND k = 'Driving environment') AS m0, max(v) FILTER (what = 'f' AND k = 'Driving environment') AS fg, max(v) FILTER (what = 'f' AND k = 'Gravel road') AS fo FROM val GROUP BY ALL),
d AS (
  SELECT pr.run_id, pr.uuid, gt, cs, fields, why, c.rest, gs['Driving environment'] AS g0, list_has_any(pred, unk) AS dropped, len(list_intersect(pred, list_filter(c.every, lambda x: NOT list_contains(unk, x)))) > 0 AS some_left, len(list_intersect(pred, c.rest)) > 0 AS rest_left, m0, fg, fo,
    list_has_any(regexp_extract_all(why, 'recheck (.+?): ', 1), c.every) AS asked, coalesce(try_cast(nullif(regexp_extract(why, '(?:^| [|] )Gravel road=([0-9]+):', 1), '') AS INT), 0) AS said
  FROM pr LEFT JOIN v3 USING (run_id, uuid), c),
e AS (SELECT *, CASE WHEN m0 IS NOT NULL AND dropped AND NOT some_left THEN 0 ELSE m0 END AS m FROM d WHERE cs IS NOT NULL AND g0 IS NOT NULL AND g0 <> -1 AND m0 IS NOT NULL),
x AS (
  SELECT run_id, uuid, 'Driving environment: Others' AS name, coalesce(list_max(list_transform(list_intersect(gt, rest), lambda k: coalesce(cs[k], 0))), 0) AS t,
    CASE WHEN m = 0 THEN 0 WHEN dropped AND NOT rest_left AND (fields IS NOT NULL OR NOT asked) THEN 0 WHEN fields IS NOT NULL THEN coalesce(fg, 0) WHEN asked THEN NULL WHEN greatest(said, 0) < m THEN m END AS p FROM e
  UNION ALL SELECT run_id, uuid, 'Gravel road', CASE WHEN list_contains(gt, 'Gravel road') THEN coalesce(cs['Gravel road'], 0) ELSE 0 END, CASE WHEN m = 0 THEN 0 WHEN fields IS NOT NULL THEN coalesce(fo, 0) WHEN NOT asked THEN said END FROM e),
sx AS (SELECT * FROM x WHERE p IS NOT NULL AND t IS NOT NULL) {_ORDINAL.format('sx')}""",
    "restriction_counts": f"""WITH {PAIRS}, k AS (SELECT list(class_name) AS cs FROM grp WHERE group_name = 'Dynamic object'), r AS (SELECT run_id, gt, list_intersect(gt, cs) AS kept FROM pairs, k)
SELECT run_id, count(*) AS n, sum(len(gt) - len(kept))::BIGINT AS n_drop, count(*) FILTER (len(gt) > 0 AND len(kept) = 0) AS n_normal FROM r GROUP BY run_id""",
    "class_table": f"""WITH {PAIRS}, {_classes('gt', 'NOT coalesce(is_unknown, false)')}, s AS (SELECT *, tp + fn AS support, {PRF} FROM counts), g AS (SELECT group_name, min(group_pos) AS gp FROM taxonomy GROUP BY 1)
SELECT s.run_id, s.class_name, t.group_name, support, tp, fp, fn, (row_number() OVER (PARTITION BY s.run_id ORDER BY g.gp NULLS LAST, coalesce(t.is_unknown, false), support DESC, s.class_name))::INT AS place FROM s LEFT JOIN taxonomy t USING (class_name) LEFT JOIN g USING (group_name)""",
    "conflicts": f"""WITH {PAIRS}, {PARTS},
both_sides AS (SELECT run_id, 'gt' AS side, name, t AS v, uuid FROM gt UNION ALL SELECT run_id, 'pred', name, p, uuid FROM ps),
j AS (SELECT b.*, len(list_intersect(CASE WHEN side = 'gt' THEN p.gt ELSE p.pred END, coalesce(cs, []))) > 0 AS has FROM both_sides b JOIN pairs p USING (run_id, uuid) LEFT JOIN (SELECT group_name, list(class_name) AS cs FROM grp GROUP BY 1) g ON g.group_name = b.name)
SELECT run_id, side, name, count(*) FILTER ((v = 0 AND has) OR (v >= 1 AND NOT has)) AS n FROM j GROUP BY ALL""",
    "axis_summary": f"WITH {PAIRS}, {AXES} SELECT run_id, name, count(*) AS n, avg((t - p) * (t - p)) AS mse, avg((t = p)::INT) AS exact, avg((abs(t - p) <= 1)::INT) AS within_one, avg(t) AS mean_gt, avg(p) AS mean_pred FROM ax GROUP BY ALL",
    "axis_ordinal": f"WITH {PAIRS}, {AXES} {_ORDINAL.format('ax')}",
    "name_drift": f"""WITH {PAIRS}, u AS (SELECT run_id, unnest(gt) AS class_name, true AS l, false AS r FROM pairs UNION ALL SELECT run_id, unnest(pred), false, true FROM pairs),
n AS (SELECT run_id, class_name, bool_or(l) AS in_labels, bool_or(r) AS in_results, class_name IN (SELECT class_name FROM grp) AS in_taxonomy FROM u GROUP BY ALL)
SELECT * FROM n WHERE NOT (in_labels AND in_results AND in_taxonomy)""",
    "missing_clips": "SELECT DISTINCT lower(trim(uuid)) AS uuid FROM labels_store WHERE class_list IS NOT NULL AND lower(trim(uuid)) NOT IN (SELECT lower(trim(uuid)) FROM clip_results)",
}
