"""Queries of the general problems 1, 2, 3 and 5, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelgrid.operators import changes, copies, drift, intervals
from reelgrid.session import cut, scratch, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Differences between label store and mirror, field by field."""
    return copies.label_differences(table(spark, sf, "labels_store"), table(spark, sf, "labels_mirror"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Assigned chunks after all events of the change feed."""
    return changes.assigned_chunks(table(spark, sf, "assignments"), scratch(spark, "assignments"), widest=None)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of fields between the files of each label set."""
    return drift.record_drift(table(spark, sf, "label_records"))


def p3_table(spark: SparkSession, sf: str) -> DataFrame:
    """All label records in one table, renamed fields replayed into their columns."""
    read = cut(drift.ingest(table(spark, sf, "label_records")))
    approved = drift.renamed_columns(read) | drift.KNOWN_NAMES
    return drift.promote(read, approved).drop("_readable")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Continuous periods and gaps of each clip and class."""
    return intervals.span_periods(table(spark, sf, "clip_results"), table(spark, sf, "taxonomy"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_table, p5_found)}

_TRIM = r"'^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$', '', 'g'"

SQL = {
    "p1_found": rf"""
WITH two AS (
  SELECT 's' AS side, * FROM labels_store UNION ALL BY NAME SELECT 'm' AS side, * FROM labels_mirror),
norm AS (
  SELECT side, lower(regexp_replace(uuid, {_TRIM})) AS uuid, rev,
    coalesce(group_scores['Dynamic object'], -1) AS d, coalesce(group_scores['Driving environment'], -1) AS e,
    regexp_replace(replace(coalesce(note, ''), chr(13) || chr(10), chr(10)), {_TRIM}) AS note
  FROM two),
cur AS (SELECT DISTINCT ON (side, uuid) * FROM norm ORDER BY side, uuid, rev DESC),
j AS (
  SELECT coalesce(s.uuid, m.uuid) AS uuid, s.side AS a, m.side AS b, s.d AS sd, m.d AS md, s.e AS se, m.e AS me, s.note AS sn, m.note AS mn
  FROM (SELECT * FROM cur WHERE side = 's') s FULL JOIN (SELECT * FROM cur WHERE side = 'm') m ON s.uuid = m.uuid)
SELECT uuid, 'only_store' AS kind, '' AS field FROM j WHERE b IS NULL
UNION ALL SELECT uuid, 'only_mirror', '' FROM j WHERE a IS NULL
UNION ALL SELECT uuid, 'differs', 'Dynamic object' FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND sd <> md
UNION ALL SELECT uuid, 'differs', 'Driving environment' FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND se <> me
UNION ALL SELECT uuid, 'differs', 'note' FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND sn <> mn""",
    "p2_found": r"""
WITH e AS (
  SELECT store_id, event_id, try_cast(ts AS TIMESTAMPTZ) AS t, tie_no, lower(trim(action)) AS action, user_id,
    list_filter(regexp_split_to_array(coalesce(chunks, ''), '[,\s]+'), lambda x: x <> '') AS c,
    list_filter(regexp_split_to_array(coalesce(removed, ''), '[,\s]+'), lambda x: x <> '') AS r
  FROM assignments),
ok AS (
  SELECT * FROM e WHERE t IS NOT NULL AND action IN ('assign', 'unassign')
    AND len(list_filter(list_concat(c, r), lambda x: NOT regexp_full_match(x, '[0-9]+(-[0-9]+)?'))) = 0),
parts AS (
  SELECT store_id, t, tie_no, event_id, 0 AS step, NULL AS user_id, unnest(r) AS p FROM ok
  UNION ALL
  SELECT store_id, t, tie_no, event_id, 1, CASE WHEN action = 'assign' THEN user_id END, unnest(c) FROM ok),
ends AS (
  SELECT *, split_part(p, '-', 1)::BIGINT AS a, CASE WHEN p LIKE '%-%' THEN split_part(p, '-', 2) ELSE p END::BIGINT AS b FROM parts),
nums AS (
  SELECT store_id, t, tie_no, event_id, step, user_id, unnest(range(least(a, b), greatest(a, b) + 1)) AS chunk FROM ends),
last AS (
  SELECT DISTINCT ON (store_id, chunk) store_id, chunk::BIGINT AS chunk, user_id FROM nums
  ORDER BY store_id, chunk, t DESC, tie_no DESC, event_id DESC, step DESC)
SELECT store_id, chunk, user_id FROM last WHERE user_id IS NOT NULL""",
}
