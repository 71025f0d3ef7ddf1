"""Queries of the label store, time series, tensors and lineage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import model_text
from reelgrid.functions.text import key_text
from reelgrid.functions.times import epoch_us
from reelgrid.operators import changes, labelstore, lineage, merge, numbering, spans, tensors, timeseries
from reelgrid.operators import evaluate as ev
from reelgrid.plans.evaluation import BEST
from reelgrid.session import scratch, table

LAYERS = 8


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels_store").withColumn("uuid", key_text(F.col("uuid")))


def _current(spark: SparkSession, sf: str, name: str = "labels_store") -> DataFrame:
    return ev.current_labels(table(spark, sf, name))


def _clips(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "clip_results").select(key_text(F.col("uuid")).alias("uuid")).distinct()


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """The events table read as vehicle samples, one series for each user; an hour counts as a second."""
    e = table(spark, sf, "events")
    t = F.floor(epoch_us(F.col("ts")) / 3600).cast("bigint")
    return e.select(F.col("user_id").alias("uuid"), t.alias("t_us"), (F.col("value") / 10).alias("speed"), ((F.col("value") - 50) / 10).alias("ax"), (F.pmod(F.floor(F.col("value") * 700), F.lit(36000)) / 100 - 180).alias("yaw_deg"), F.col("value").alias("x"), "event_type", "event_id")


def history_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Current labels with their audit."""
    return labelstore.fold(_events(spark, sf).select("uuid", "rev", "updated_at", "labeler", "note")).select("uuid", "rev", "created_at", "created_by", F.array_join("authors", "|").alias("authors"), "note")


def history_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What each revision changed."""
    return labelstore.history(_events(spark, sf))


def poll_since(spark: SparkSession, sf: str) -> DataFrame:
    """Labels changed after a time."""
    return labelstore.poll(_events(spark, sf).select("uuid", epoch_us(F.col("updated_at")).alias("seq")), F.lit(1771000000000000))


def label_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Labels, labelers and last change of each dataset."""
    return labelstore.meta(_current(spark, sf))


def progress_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Clips by labeler."""
    return labelstore.progress(_clips(spark, sf), _current(spark, sf))


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    return changes.assigned_ranges(table(spark, sf, "assignments"), scratch(spark, "assignments"))


def assignment_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each user."""
    return labelstore.assignment_summary(_assigned(spark, sf))


def auto_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Free chunks of each store dealt to three users."""
    return labelstore.auto_assign(labelstore.free_ranges(_assigned(spark, sf)), ["ann", "bob", "cleo"], 5)


def next_unlabeled(spark: SparkSession, sf: str) -> DataFrame:
    """The next clip to label after each one, within the first digit of its uuid."""
    have = _current(spark, sf).select("uuid", F.lit(1).alias("has"))
    rows = _clips(spark, sf).join(have, "uuid", "left").select("uuid", F.substring("uuid", 1, 1).alias("group"), F.col("has").isNull().alias("open"))
    return labelstore.next_open(rows)


def clip_list_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of labels of one labeler, newest first."""
    return labelstore.page(_current(spark, sf), F.col("labeler.id") == "lab01", [F.desc("updated_at"), F.col("uuid")], 20, 10).select("uuid", "updated_at")


def active_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that hold at the middle of the events, read as claims of 40 clips."""
    e = table(spark, sf, "events").select(F.concat(F.lit("clip"), F.pmod("event_id", F.lit(40))).alias("uuid"), F.col("user_id").cast("string").alias("user_id"), "ts", F.col("event_id").alias("seq"))
    return labelstore.active_claims(e, F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"), 90_000)


def save_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """The mirror's labels saved over the store's, each from the revision before its own."""
    saves = _current(spark, sf, "labels_mirror").withColumn("base_rev", F.col("rev") - 1)
    return labelstore.save_outcomes(_current(spark, sf), saves)


def import_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What bringing the mirror's labels in would do."""
    return labelstore.import_counts(_current(spark, sf), _current(spark, sf, "labels_mirror"), _clips(spark, sf))


def label_patch(spark: SparkSession, sf: str) -> DataFrame:
    """Current labels of the store after taking over the mirror's notes and nights, and deleting what is night without a note there."""
    mirror = _current(spark, sf, "labels_mirror")
    puts = mirror.select("uuid", F.lit(1).alias("seq"), (F.col("note").isNull() & F.col("is_night")).alias("is_delete"), F.array(F.lit("note"), F.lit("is_night")).alias("fields"), "note", "is_night", F.lit(9).alias("rev"))
    return labelstore.patch_labels(_current(spark, sf).select("uuid", "rev", "note", "is_night", "influenced_ego"), puts)


def label_errors(spark: SparkSession, sf: str) -> DataFrame:
    """What forbids saving the mirror's labels over the store's."""
    tax = ev.Taxonomy.of(table(spark, sf, "taxonomy"))
    found = labelstore.label_errors(_current(spark, sf, "labels_mirror"), _current(spark, sf), tax, of_group={"Dynamic object": [0, 1, 2, 3]}, longest_note=40)
    return found.select("uuid", F.explode("errors").alias("error"))


def label_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """The mirror as a kept document against the store's log."""
    return labelstore.mismatches(_current(spark, sf, "labels_mirror"), _current(spark, sf))


def _view(spark: SparkSession, sf: str) -> DataFrame:
    """Clips in chunks of a hundred, all of the first store."""
    state = changes.assigned_chunks(table(spark, sf, "assignments"), scratch(spark, "assignments"), widest=None)
    first = table(spark, sf, "assignments").agg(F.min("store_id")).first()[0]
    clips = numbering.in_chunks(_clips(spark, sf), [F.col("uuid")]).withColumnRenamed("chunk_no", "chunk").withColumn("store_id", F.lit(first))
    e = table(spark, sf, "events").select(F.concat(F.lit("clip"), F.pmod("event_id", F.lit(40))).alias("uuid"), F.col("user_id").cast("string").alias("user_id"), "ts", F.col("event_id").alias("seq"))
    claims = labelstore.active_claims(e, F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"), 90_000)
    return labelstore.clip_view(clips, labelstore.fold(_events(spark, sf).select("uuid", "rev", "updated_at", "labeler")), claims, state)


def clip_view(spark: SparkSession, sf: str) -> DataFrame:
    """Clips with label, audit, claim and assignment."""
    return _view(spark, sf).withColumn("authors", F.coalesce(F.array_join("authors", "|"), F.lit("")))


def user_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of one labeler."""
    return labelstore.counts_of(_view(spark, sf), "lab01")


def assignment_log(spark: SparkSession, sf: str) -> DataFrame:
    """The last thirty assignment events, each once, newest first."""
    e = table(spark, sf, "assignments").groupBy("event_id").agg(F.min("store_id").alias("store_id"), F.min(changes.instant(F.col("ts"))).alias("t_us"), F.min("tie_no").alias("tie_no"))
    return labelstore.last_events(e.where("t_us IS NOT NULL"), [F.desc("t_us"), F.desc("tie_no"), F.desc("event_id")])


def unassigned_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Free chunks of each store below its last assigned one, as a list."""
    free = labelstore.free_ranges(_assigned(spark, sf))
    return labelstore.assignment_summary(free.withColumn("user_id", F.lit(None).cast("string"))).drop("user_id")


def ego_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Summary of each series."""
    return timeseries.summary(_samples(spark, sf))


def ego_described(spark: SparkSession, sf: str) -> DataFrame:
    """Each series in words."""
    return timeseries.described(timeseries.summary(_samples(spark, sf)))


def ego_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How many clips the label store and its mirror know."""
    label = lambda name: _current(spark, sf, name).select("uuid")
    return timeseries.coverage(_clips(spark, sf), store=label("labels_store"), mirror=label("labels_mirror"))


def unwrap_heading(spark: SparkSession, sf: str) -> DataFrame:
    """Heading along each series."""
    return timeseries.heading(_samples(spark, sf)).select("uuid", "t_us", "turn", "heading")


def stopped_seconds_2hz(spark: SparkSession, sf: str) -> DataFrame:
    """Time weights of samples, as whole half microseconds."""
    return timeseries.half_gaps(_samples(spark, sf)).select("uuid", "t_us", F.round(F.col("weight_s") * 2e6).cast("bigint").alias("half_us"))


def ego_window_join(spark: SparkSession, sf: str) -> DataFrame:
    """Samples within the windows that purchases open."""
    s = _samples(spark, sf)
    return timeseries.within_windows(s, s.where("event_type = 'purchase'").select("uuid", (F.col("t_us") - 15_000_000).alias("beg"), (F.col("t_us") + 15_000_000).alias("end")))


def asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    """For each purchase the last view before it."""
    s = _samples(spark, sf)
    return timeseries.asof(s.where("event_type = 'purchase'").select("uuid", "t_us", F.col("event_id").alias("id")), s.where("event_type = 'view'").select("uuid", "t_us", "speed"), ["speed"])


def asof_forward(spark: SparkSession, sf: str) -> DataFrame:
    """For each purchase the first view after it."""
    s = _samples(spark, sf)
    return timeseries.asof(s.where("event_type = 'purchase'").select("uuid", "t_us", F.col("event_id").alias("id")), s.where("event_type = 'view'").select("uuid", "t_us", "speed"), ["speed"], forward=True)


def future_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """Samples up to 20 seconds ahead."""
    return timeseries.horizon(_samples(spark, sf), 20.0)


def valid_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of samples that aren't errors."""
    return timeseries.segments(_samples(spark, sf), F.col("event_type") != "error")


def path_gradient(spark: SparkSession, sf: str) -> DataFrame:
    """Slope along each series."""
    return timeseries.gradient(_samples(spark, sf), "x")


def allow_list(spark: SparkSession, sf: str) -> DataFrame:
    """Clips with results that the mirror lists, in the list's order."""
    listed = numbering.global_row_number(_current(spark, sf, "labels_mirror").select("uuid"), [F.desc("uuid")], "pos")
    return merge.allowed(_clips(spark, sf), listed)


def dataset_order(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled clips with their place among the clips that have results; others come last."""
    placed = numbering.global_row_number(_clips(spark, sf), [F.col("uuid")], "pos")
    return merge.in_dataset_order(_current(spark, sf).select("uuid"), placed)


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Label events numbered by time, among all and among those of their clip."""
    e = _events(spark, sf).groupBy("uuid", "updated_at").agg(F.max("note").alias("note"))
    return numbering.revisions(e, [F.col("updated_at"), F.col("uuid")])


def reason_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons of results under the class that begins them."""
    names = [r.class_name for r in table(spark, sf, "taxonomy").where("group_name = 'Dynamic object'").orderBy("class_pos").collect()]
    df = table(spark, sf, "clip_results").select("run_id", "uuid", "shard_no", "loaded_at", F.explode(model_text.reason_parts(F.col("score_reason"), names)).alias("p"))
    return df.select("run_id", "uuid", "shard_no", "loaded_at", "p.name", "p.text")


def per_class_quota(spark: SparkSession, sf: str) -> DataFrame:
    """The first three special clips of each run, shard and class cell."""
    best = ev.best_results(table(spark, sf, "clip_results").select("run_id", "uuid", "shard_no", "loaded_at", "n_frames", "verdict", "classes"))
    return numbering.quota(best.where("verdict = 'Special'"), ["run_id", "shard_no", "classes"], [F.col("loaded_at"), F.col("uuid")], 3).select("run_id", "shard_no", "classes", "uuid")


def chunking(spark: SparkSession, sf: str) -> DataFrame:
    """Clips in chunks of a hundred."""
    return numbering.in_chunks(_clips(spark, sf), [F.col("uuid")])


def shard_stride_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Clips of shard 1 of 4 that aren't labelled yet; clips are dealt to shards first."""
    return numbering.stride(_clips(spark, sf), [F.col("uuid")], 1, 4).join(_current(spark, sf).select("uuid"), "uuid", "left_anti")


def text_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of each document."""
    return table(spark, sf, "documents").select("doc_id", lineage.fingerprint(F.col("text")).alias("print"))


def index_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Entries and last change of each source."""
    return lineage.index_fingerprint(table(spark, sf, "documents"), ["source"], "edited_at")


def index_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The last revision of each page."""
    return lineage.index_last_wins(table(spark, sf, "documents"), ["page_id"], ["rev_no"], "doc_id")


def source_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Of each page one document, from the best source that has it."""
    return lineage.by_priority(table(spark, sf, "documents"), ["page_id"], "source", ["live_feed", "mirror_b"], "doc_id", "doc_id")


def config_diff(spark: SparkSession, sf: str) -> DataFrame:
    """How each run's figures differ from those of the run before it."""
    from pyspark.sql import Window

    runs = table(spark, sf, "clip_results").groupBy("run_id").agg(F.max("n_frames").alias("f"), F.max("shard_no").alias("s"), F.max("margin_min").alias("m"))
    text = lambda c: F.col(c).cast("string")
    maps = runs.select("run_id", F.create_map(F.lit("frames"), text("f"), F.lit("shards"), text("s"), F.lit("run"), F.col("run_id")).alias("new"))
    w = Window.orderBy("run_id")  # one row for each run
    rows = maps.withColumn("old", F.lag("new").over(w)).where("old IS NOT NULL")
    return rows.select("run_id", F.explode(lineage.config_diff(F.col("old"), F.col("new"), ["run"])).alias("d")).select("run_id", "d.*")


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return tensors.long_form(table(spark, sf, "embeddings"), LAYERS)


def attention_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Bucket shares of tokens against the mean."""
    return tensors.bucket_ratio(table(spark, sf, "embeddings"), LAYERS)


def spatial_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean values of each token set."""
    return tensors.group_means(_cells(spark, sf), table(spark, sf, "embeddings").select(F.col("vec_id").alias("tok"), F.col("label").alias("grp")))


def sink_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Sinks by layer."""
    return tensors.sink_mask(_cells(spark, sf))


def sink_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Number of sinks by layer."""
    return tensors.sink_summary(tensors.sink_mask(_cells(spark, sf)))


def decision_margin(spark: SparkSession, sf: str) -> DataFrame:
    """Leads of the greatest value by label."""
    return tensors.margins(table(spark, sf, "embeddings"), "label")


def span_snap(spark: SparkSession, sf: str) -> DataFrame:
    """Scored spans of each result row on whole seconds."""
    rows = table(spark, sf, "clip_results").select("run_id", "uuid", "shard_no", "loaded_at", "time_spans")
    return spans.snap(spans.read_scored(rows), ["run_id", "uuid", "shard_no", "loaded_at", "class_name"])


_ALL = (span_snap, history_fold, history_diff, poll_since, label_meta, progress_counts, assignment_summary, auto_assign, next_unlabeled, clip_list_page, active_claims, save_conflicts, import_counts, label_patch, label_errors, label_mismatches, clip_view, user_counts, assignment_log, unassigned_chunks, ego_summary, ego_described, ego_coverage, allow_list, dataset_order, revisions, reason_parts, unwrap_heading, stopped_seconds_2hz, ego_window_join, asof_backward, asof_forward, future_horizon, valid_segments, path_gradient, per_class_quota, chunking, shard_stride_antijoin, text_fingerprint, index_fingerprint, index_last_wins, source_priority, config_diff, attention_ratio, spatial_means, sink_mask, sink_summary, decision_margin)
QUERIES = {f.__name__: f for f in _ALL}

_EV = "ev AS (SELECT * EXCLUDE (uuid), lower(trim(uuid)) AS uuid FROM labels_store)"
_CUR = "{0} AS (SELECT * FROM (SELECT * EXCLUDE (uuid), lower(trim(uuid)) AS uuid, row_number() OVER (PARTITION BY lower(trim(uuid)) ORDER BY rev DESC, updated_at DESC) AS rn FROM {1}) WHERE rn = 1)"
_CLIPS = "clips AS (SELECT DISTINCT lower(trim(uuid)) AS uuid FROM clip_results)"
_S = "s AS (SELECT user_id AS uuid, (epoch_us(ts) // 3600)::BIGINT AS t_us, value / 10 AS speed, (value - 50) / 10 AS ax, (floor(value * 700)::BIGINT % 36000) / 100 - 180 AS yaw_deg, value AS x, event_type, event_id FROM events)"
_FIELDS = """fields AS (
  SELECT uuid, rev, p || '.' || e.key AS field, e.value::VARCHAR AS val FROM (
    SELECT uuid, rev, 'group_scores' AS p, unnest(map_entries(group_scores)) AS e FROM {0} UNION ALL SELECT uuid, rev, 'classes', unnest(map_entries(classes)) FROM {0} UNION ALL SELECT uuid, rev, 'weather', unnest(map_entries(weather)) FROM {0}) WHERE e.value IS NOT NULL
  UNION ALL SELECT uuid, rev, 'class_list', array_to_string(list_sort(list_distinct(class_list)), '|') FROM {0} WHERE class_list IS NOT NULL
  UNION ALL SELECT uuid, rev, 'rain_snow_fog', array_to_string(list_sort(list_distinct(rain_snow_fog)), '|') FROM {0} WHERE rain_snow_fog IS NOT NULL
  UNION ALL SELECT uuid, rev, 'has_class_scores', has_class_scores::VARCHAR FROM {0} WHERE has_class_scores IS NOT NULL
  UNION ALL SELECT uuid, rev, 'influenced_ego', influenced_ego::VARCHAR FROM {0} WHERE influenced_ego IS NOT NULL
  UNION ALL SELECT uuid, rev, 'is_night', is_night::VARCHAR FROM {0} WHERE is_night IS NOT NULL
  UNION ALL SELECT uuid, rev, 'note', note FROM {0} WHERE note IS NOT NULL)"""
#: A label as one text, to compare.
_FLAT = "list_sort(list_transform(list_filter(map_entries(coalesce({0}.group_scores, MAP {{}})), lambda e: e.value IS NOT NULL), lambda e: e.key || e.value)), list_sort(list_transform(list_filter(map_entries(coalesce({0}.classes, MAP {{}})), lambda e: e.value IS NOT NULL), lambda e: e.key || e.value)), list_sort(list_transform(list_filter(map_entries(coalesce({0}.weather, MAP {{}})), lambda e: e.value IS NOT NULL), lambda e: e.key || e.value)), list_sort(list_distinct({0}.class_list)), list_sort(list_distinct({0}.rain_snow_fog)), {0}.has_class_scores, {0}.influenced_ego, {0}.is_night, {0}.note"
_STATE = r"""e AS (
  SELECT store_id, event_id, try_cast(ts AS TIMESTAMPTZ) AS t, tie_no, lower(trim(action)) AS action, user_id,
    list_filter(regexp_split_to_array(coalesce(chunks, ''), '[,\s]+'), lambda x: x <> '') AS c, list_filter(regexp_split_to_array(coalesce(removed, ''), '[,\s]+'), lambda x: x <> '') AS r FROM assignments),
ok AS (SELECT * FROM e WHERE len(list_filter(list_concat(c, r), lambda x: NOT regexp_full_match(x, '[0-9]+(-[0-9]+)?'))) = 0),
parts AS (SELECT store_id, t, tie_no, event_id, 0 AS step, NULL AS user_id, unnest(r) AS p FROM ok UNION ALL SELECT store_id, t, tie_no, event_id, 1, CASE WHEN action = 'assign' THEN user_id END, unnest(c) FROM ok),
ends AS (SELECT *, split_part(p, '-', 1)::BIGINT AS a, CASE WHEN p LIKE '%-%' THEN split_part(p, '-', 2) ELSE p END::BIGINT AS b FROM parts),
nums AS (SELECT store_id, t, tie_no, event_id, step, user_id, unnest(range(least(a, b), greatest(a, b) + 1)) AS chunk FROM ends),
st AS (SELECT store_id, chunk, user_id FROM (SELECT *, row_number() OVER (PARTITION BY store_id, chunk ORDER BY t DESC, tie_no DESC, event_id DESC, step DESC) AS rn FROM nums) WHERE rn = 1 AND user_id IS NOT NULL)"""
_CELLS = f"cells AS (SELECT vec_id AS tok, label AS grp, (i // (len(embedding) // {LAYERS}))::INT AS layer, (i % (len(embedding) // {LAYERS}))::INT AS bucket, abs(embedding[i + 1]::DOUBLE) AS v FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings))"
_SINK = "m AS (SELECT layer, bucket, v > 0.2 * sum(v) OVER (PARTITION BY layer) AS is_sink FROM cells WHERE tok = (SELECT min(tok) FROM cells))"

SQL = {
    "history_fold": f"""WITH {_EV}, {_CUR.format("cur", "labels_store")},
f AS (SELECT uuid, arg_min(updated_at, (rev, updated_at)) AS created_at FROM ev GROUP BY uuid),
w AS (SELECT uuid, labeler.id AS who, min(rev) AS t, min(updated_at) FILTER (rev = mr) AS u FROM (SELECT *, min(rev) OVER (PARTITION BY uuid, labeler.id) AS mr FROM ev) GROUP BY ALL),
a AS (SELECT uuid, first(who ORDER BY t, u) AS created_by, string_agg(who, '|' ORDER BY t, who) AS authors FROM w GROUP BY uuid)
SELECT uuid, rev, created_at, created_by, coalesce(authors, '') AS authors, note FROM cur JOIN f USING (uuid) JOIN a USING (uuid)""",
    "history_diff": f"""WITH {_EV}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uuid, rev ORDER BY updated_at DESC) AS rn, FROM ev) WHERE rn = 1),
seq AS (SELECT uuid, rev, lag(rev) OVER (PARTITION BY uuid ORDER BY rev) AS before FROM one), {_FIELDS.format("one")},
keys AS (SELECT s.uuid, s.rev, s.before, f.field FROM seq s JOIN fields f ON f.uuid = s.uuid AND (f.rev = s.rev OR f.rev = s.before) GROUP BY ALL)
SELECT k.uuid, k.rev, k.field, o.val AS old, n.val AS new FROM keys k LEFT JOIN fields o ON o.uuid = k.uuid AND o.rev = k.before AND o.field = k.field LEFT JOIN fields n ON n.uuid = k.uuid AND n.rev = k.rev AND n.field = k.field WHERE o.val IS DISTINCT FROM n.val""",
    "poll_since": f"WITH {_EV} SELECT uuid, max(epoch_us(updated_at)) AS seq FROM ev WHERE epoch_us(updated_at) > 1771000000000000 GROUP BY uuid",
    "label_meta": f"WITH {_CUR.format('cur', 'labels_store')} SELECT dataset_id, count(*) AS n, coalesce(string_agg(DISTINCT labeler.id, '|' ORDER BY labeler.id), '') AS labelers, strftime(max(updated_at), '%Y-%m-%d') AS last_day FROM cur GROUP BY dataset_id",
    "progress_counts": f"WITH {_CUR.format('cur', 'labels_store')}, {_CLIPS}, j AS (SELECT CASE WHEN c.uuid IS NULL THEN NULL ELSE coalesce(c.labeler.id, '') END AS labeler FROM clips LEFT JOIN cur c USING (uuid)) SELECT labeler, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM j GROUP BY labeler",
    "assignment_summary": f"""WITH {_STATE}, g AS (SELECT *, chunk - row_number() OVER (PARTITION BY store_id, user_id ORDER BY chunk) AS island FROM st),
r AS (SELECT store_id, user_id, min(chunk) AS lo, count(*) AS k, CASE WHEN count(*) = 1 THEN min(chunk)::VARCHAR ELSE min(chunk) || '-' || max(chunk) END AS t FROM g GROUP BY store_id, user_id, island)
SELECT store_id, user_id, sum(k)::BIGINT AS n_chunks, string_agg(t, ', ' ORDER BY lo) AS chunks FROM r GROUP BY ALL""",
    "auto_assign": f"""WITH {_STATE}, f AS (SELECT store_id, unnest(range(max(chunk) + 1)) AS chunk FROM st GROUP BY store_id),
n AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY chunk) AS k FROM f ANTI JOIN st USING (store_id, chunk))
SELECT store_id, chunk::BIGINT AS chunk, ['ann', 'bob', 'cleo'][((k - 1) // 5 + 1)::INT] AS user_id FROM n WHERE k <= 15""",
    "next_unlabeled": f"""WITH {_CUR.format('cur', 'labels_store')}, {_CLIPS}, c AS (SELECT clips.uuid, clips.uuid[1] AS g, cur.uuid IS NULL AS open FROM clips LEFT JOIN cur ON cur.uuid = clips.uuid)
SELECT g AS "group", uuid, nullif(coalesce(min(CASE WHEN open THEN uuid END) OVER (PARTITION BY g ORDER BY uuid ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(CASE WHEN open THEN uuid END) OVER (PARTITION BY g)), uuid) AS next_uuid FROM c""",
    "clip_list_page": f"WITH {_CUR.format('cur', 'labels_store')} SELECT uuid, updated_at FROM cur WHERE labeler.id = 'lab01' ORDER BY updated_at DESC, uuid LIMIT 10 OFFSET 20",
    "active_claims": """WITH c AS (SELECT 'clip' || event_id % 40 AS uuid, user_id::VARCHAR AS user_id, ts, event_id FROM events WHERE ts <= TIMESTAMP '2024-01-16')
SELECT l.uuid, l.user_id, ts + INTERVAL 90000 SECOND AS until FROM (SELECT uuid, arg_max(user_id, event_id) AS user_id, max(event_id) AS event_id, arg_max(ts, event_id) AS ts FROM c GROUP BY uuid) l
JOIN (SELECT user_id, arg_max(uuid, event_id) AS newest FROM c GROUP BY user_id) o ON o.user_id = l.user_id AND newest = l.uuid WHERE ts + INTERVAL 90000 SECOND >= TIMESTAMP '2024-01-16'""",
    "save_conflicts": f"""WITH {_CUR.format('cur', 'labels_store')}, {_CUR.format('mir', 'labels_mirror')}
SELECT m.uuid, CASE WHEN coalesce(c.rev, 0) <> coalesce(m.rev - 1, 0) THEN 'conflict' WHEN c.uuid IS NULL THEN 'created' WHEN row({_FLAT.format('c')}) IS NOT DISTINCT FROM row({_FLAT.format('m')}) THEN 'unchanged' ELSE 'saved' END AS outcome FROM mir m LEFT JOIN cur c USING (uuid)""",
    "label_patch": f"""WITH {_CUR.format('cur', 'labels_store')}, {_CUR.format('mir', 'labels_mirror')}
SELECT coalesce(c.uuid, m.uuid) AS uuid, c.rev, CASE WHEN m.uuid IS NULL THEN c.note ELSE m.note END AS note, CASE WHEN m.uuid IS NULL THEN c.is_night ELSE m.is_night END AS is_night, c.influenced_ego
FROM cur c FULL JOIN mir m USING (uuid) WHERE m.uuid IS NULL OR NOT coalesce(m.note IS NULL AND m.is_night, false)""",
    "label_errors": f"""WITH {_CUR.format('cur', 'labels_store')}, {_CUR.format('mir', 'labels_mirror')}, j AS (SELECT m.*, c.classes AS was, c.group_scores AS gwas FROM mir m LEFT JOIN cur c USING (uuid)),
x AS (SELECT uuid, was, unnest(map_entries(classes)) AS e FROM j), g AS (SELECT uuid, gwas, unnest(map_entries(group_scores)) AS e FROM j), w AS (SELECT uuid, unnest(map_entries(weather)) AS e FROM j)
SELECT uuid, 'unknown class ' || e.key AS error FROM x WHERE e.key NOT IN (SELECT class_name FROM taxonomy WHERE class_name IS NOT NULL) AND NOT list_contains(map_keys(coalesce(was, MAP {{}})), e.key)
UNION ALL SELECT uuid, 'classes.' || e.key || ' = ' || e.value FROM x WHERE e.value NOT BETWEEN 1 AND 4 AND e.value IS DISTINCT FROM was[e.key]
UNION ALL SELECT uuid, 'group_scores.' || e.key || ' = ' || e.value FROM g WHERE NOT (CASE WHEN e.key = 'Dynamic object' THEN e.value BETWEEN 0 AND 3 ELSE e.value BETWEEN 0 AND 4 END) AND e.value IS DISTINCT FROM gwas[e.key]
UNION ALL SELECT uuid, 'weather.' || e.key || ' = ' || e.value FROM w WHERE e.value NOT BETWEEN 0 AND 4
UNION ALL SELECT uuid, 'unknown tag ' || t FROM (SELECT uuid, unnest(list_distinct(rain_snow_fog)) AS t FROM j) WHERE t NOT IN ('rain', 'snow', 'fog')
UNION ALL SELECT uuid, 'note of ' || length(note) || ' characters' FROM j WHERE length(note) > 40""",
    "label_mismatches": f"""WITH {_CUR.format('cur', 'labels_store')}, {_CUR.format('mir', 'labels_mirror')}, j AS (
SELECT coalesce(c.uuid, m.uuid) AS uuid, CASE WHEN m.uuid IS NULL THEN 'missing' WHEN c.uuid IS NULL THEN 'extra' WHEN row({_FLAT.format('c')}) IS DISTINCT FROM row({_FLAT.format('m')}) THEN 'different' END AS state FROM cur c FULL JOIN mir m USING (uuid)) SELECT * FROM j WHERE state IS NOT NULL""",
    "clip_view": "SELECT * REPLACE (coalesce(authors, '') AS authors) FROM (VIEW)",
    "user_counts": "SELECT count(*) AS total, count(*) FILTER (labeled) AS n_labeled, count(*) FILTER (claimed_by IS NOT NULL) AS n_claimed, count(*) FILTER (list_contains(string_split(coalesce(authors, ''), '|'), 'lab01')) AS mine, count(*) FILTER (assignee = 'lab01') AS n_assigned, count(*) FILTER (assignee = 'lab01' AND labeled) AS assigned_labeled FROM (VIEW)",
    "assignment_log": "SELECT event_id, min(store_id) AS store_id, min(epoch_us(try_cast(ts AS TIMESTAMPTZ))) AS t_us, min(tie_no) AS tie_no FROM assignments GROUP BY event_id HAVING t_us IS NOT NULL ORDER BY t_us DESC, tie_no DESC, event_id DESC LIMIT 30",
    "unassigned_chunks": f"""WITH {_STATE}, f AS (SELECT store_id, unnest(range(max(chunk) + 1)) AS chunk FROM st GROUP BY store_id), o AS (SELECT * FROM f ANTI JOIN st USING (store_id, chunk)),
g AS (SELECT *, chunk - row_number() OVER (PARTITION BY store_id ORDER BY chunk) AS island FROM o), r AS (SELECT store_id, min(chunk) AS lo, count(*) AS k, CASE WHEN count(*) = 1 THEN min(chunk)::VARCHAR ELSE min(chunk) || '-' || max(chunk) END AS t FROM g GROUP BY store_id, island)
SELECT store_id, sum(k)::BIGINT AS n_chunks, string_agg(t, ', ' ORDER BY lo) AS chunks FROM r GROUP BY store_id""",
    "import_counts": f"WITH {_CUR.format('cur', 'labels_store')}, {_CUR.format('mir', 'labels_mirror')}, {_CLIPS} SELECT CASE WHEN c.uuid IS NULL THEN 'missing' WHEN l.uuid IS NOT NULL THEN 'kept' ELSE 'added' END AS outcome, count(*) AS n FROM mir m LEFT JOIN clips c ON c.uuid = m.uuid LEFT JOIN cur l ON l.uuid = m.uuid GROUP BY ALL",
    "ego_summary": f"""WITH {_S}, w AS (SELECT *, coalesce((t_us - lag(t_us) OVER o) / 2e6, 0) + coalesce((lead(t_us) OVER o - t_us) / 2e6, 0) AS wt, yaw_deg - lag(yaw_deg) OVER o AS d, min(t_us) OVER (PARTITION BY uuid) AS t0 FROM s WINDOW o AS (PARTITION BY uuid ORDER BY t_us))
SELECT uuid, count(*) AS n, (max(t_us) - min(t_us)) / 1e6 AS span_s, arg_min(speed, t_us) * 3.6 AS speed_start, arg_max(speed, t_us) * 3.6 AS speed_end, min(speed) * 3.6 AS speed_min, max(speed) * 3.6 AS speed_max, min(ax) AS min_ax, max(ax) AS max_ax,
  (arg_min(t_us, (ax, t_us)) - min(t_us)) / 1e6 AS t_min_ax, (arg_min(t_us, (speed, t_us)) - min(t_us)) / 1e6 AS t_speed_min, sum(CASE WHEN speed < 0.5 THEN wt ELSE 0 END) AS stopped_s, sum(coalesce(d - 360 * floor((d + 180) / 360), 0)) AS heading_delta FROM w GROUP BY uuid""",
    "ego_described": f"""WITH SUMMARY, d AS (SELECT *, speed_start >= 7.2 AND speed_end < 1.8 AS halt, speed_start < 1.8 AND speed_end >= 7.2 AS go FROM sm)
SELECT uuid, 'Over these ' || round_even(span_s, 0)::BIGINT || ' seconds ' || CASE WHEN halt THEN 'the ego-vehicle slowed from ' || round_even(speed_start, 0)::BIGINT || ' km/h and came to a stop'
    WHEN go THEN 'the ego-vehicle pulled away from a stop to ' || round_even(speed_end, 0)::BIGINT || ' km/h' WHEN speed_max - speed_min < 5 THEN 'the ego-vehicle held a steady ' || round_even(speed_max, 0)::BIGINT || ' km/h'
    ELSE 'the ego-vehicle went from ' || round_even(speed_start, 0)::BIGINT || ' to ' || round_even(speed_end, 0)::BIGINT || ' km/h (range ' || round_even(speed_min, 0)::BIGINT || '-' || round_even(speed_max, 0)::BIGINT || ' km/h)' END
  || CASE WHEN min_ax < -3 THEN ', with a peak deceleration of ' || printf('%.1f', round_even(abs(min_ax) * 10, 0) / 10) || ' m/s^2 about ' || round_even(t_min_ax, 0)::BIGINT || ' s in' ELSE '' END
  || CASE WHEN abs(heading_delta) >= 15 THEN ', and turned ' || CASE WHEN heading_delta > 0 THEN 'left' ELSE 'right' END || ' by ' || round_even(abs(heading_delta), 0)::BIGINT || ' degrees' ELSE '' END || '.'
  || CASE WHEN stopped_s >= 2 AND NOT halt THEN ' It was stationary for about ' || round_even(stopped_s, 0)::BIGINT || ' s of that.' ELSE '' END AS behaviour,
  round_even(speed_min, 0)::BIGINT || '-' || round_even(speed_max, 0)::BIGINT AS speed_range, CASE WHEN stopped_s >= span_s - 0.5 THEN 'stopped' ELSE 'moving' END AS motion FROM d""",
    "ego_coverage": f"""WITH {_CLIPS}, {_CUR.format('cur', 'labels_store')}, {_CUR.format('mir', 'labels_mirror')}
SELECT count(*) AS n, count(c.uuid) AS with_store, 100 * count(c.uuid) / count(*) AS percent_store, count(m.uuid) AS with_mirror, 100 * count(m.uuid) / count(*) AS percent_mirror FROM clips LEFT JOIN cur c ON c.uuid = clips.uuid LEFT JOIN mir m ON m.uuid = clips.uuid""",
    "allow_list": f"WITH {_CLIPS}, {_CUR.format('mir', 'labels_mirror')}, l AS (SELECT uuid, row_number() OVER (ORDER BY uuid DESC) AS pos FROM mir) SELECT uuid, pos FROM clips JOIN l USING (uuid)",
    "dataset_order": f"WITH {_CLIPS}, {_CUR.format('cur', 'labels_store')}, l AS (SELECT uuid, row_number() OVER (ORDER BY uuid) AS pos FROM clips) SELECT cur.uuid, coalesce(pos, (SELECT count(*) FROM clips)) AS pos FROM cur LEFT JOIN l ON l.uuid = cur.uuid",
    "revisions": f"WITH {_EV}, e AS (SELECT uuid, updated_at, max(note) AS note FROM ev GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY updated_at NULLS FIRST, uuid) AS seq, (row_number() OVER (PARTITION BY uuid ORDER BY updated_at NULLS FIRST))::INT AS rev FROM e",
    "reason_parts": r"""WITH p AS (SELECT run_id, uuid, shard_no, loaded_at, row_number() OVER () AS id, string_split(score_reason, ' | ') AS ps FROM clip_results WHERE score_reason IS NOT NULL),
e AS (SELECT * EXCLUDE (ps), unnest(list_transform(ps, lambda x: trim(x))) AS part, unnest(range(len(ps))) AS i FROM p), n AS (SELECT * FROM e WHERE part <> ''),
h AS (SELECT n.*, t.class_name AS head, sum((t.class_name IS NOT NULL)::INT) OVER (PARTITION BY id ORDER BY i) AS k FROM n LEFT JOIN (SELECT class_name FROM taxonomy WHERE group_name = 'Dynamic object') t ON starts_with(part, t.class_name || ':'))
SELECT run_id, uuid, shard_no, loaded_at, max(head) AS name, string_agg(CASE WHEN head IS NULL THEN part ELSE trim(part[length(head) + 2:]) END, ' ' ORDER BY i) AS text FROM h WHERE k > 0 GROUP BY id, run_id, uuid, shard_no, loaded_at, k
UNION ALL SELECT run_id, uuid, shard_no, loaded_at, NULL, part FROM h WHERE k = 0""",
    "unwrap_heading": f"WITH {_S}, d AS (SELECT uuid, t_us, yaw_deg - lag(yaw_deg) OVER (PARTITION BY uuid ORDER BY t_us) AS d FROM s), t AS (SELECT uuid, t_us, coalesce(d - 360 * floor((d + 180) / 360), 0) AS turn FROM d) SELECT *, sum(turn) OVER (PARTITION BY uuid ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS heading FROM t",
    "stopped_seconds_2hz": f"WITH {_S} SELECT uuid, t_us, coalesce(t_us - lag(t_us) OVER o, 0) + coalesce(lead(t_us) OVER o - t_us, 0) AS half_us FROM s WINDOW o AS (PARTITION BY uuid ORDER BY t_us)",
    "ego_window_join": f"""WITH {_S}, r AS (SELECT uuid, min(t_us) AS f, max(t_us) AS l FROM s GROUP BY uuid), w AS (SELECT uuid, t_us - 15000000 AS beg, t_us + 15000000 AS "end" FROM s WHERE event_type = 'purchase'),
c AS (SELECT w.*, greatest(beg, f) AS lo, least("end", l) AS hi FROM w JOIN r USING (uuid))
SELECT c.uuid, beg, "end", lo, hi, count(*) AS n, avg(speed) AS speed FROM c JOIN s ON s.uuid = c.uuid AND t_us BETWEEN lo AND hi WHERE (hi - lo) / 1e6 >= 1 GROUP BY ALL HAVING count(*) >= 2""",
    "asof_backward": f"WITH {_S} SELECT p.uuid, p.t_us, p.event_id AS id, v.speed, v.t_us AS at_us FROM (SELECT * FROM s WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM s WHERE event_type = 'view') v ON p.uuid = v.uuid AND p.t_us >= v.t_us",
    "asof_forward": f"WITH {_S} SELECT p.uuid, p.t_us, p.event_id AS id, v.speed, v.t_us AS at_us FROM (SELECT * FROM s WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM s WHERE event_type = 'view') v ON p.uuid = v.uuid AND p.t_us <= v.t_us",
    "future_horizon": f"WITH {_S} SELECT a.uuid, a.t_us, count(*) AS n, max(b.t_us) AS last_us, arg_max(b.x, b.t_us) - a.x AS travelled FROM s a JOIN s b ON a.uuid = b.uuid AND b.t_us BETWEEN a.t_us AND a.t_us + 20000000 GROUP BY a.uuid, a.t_us, a.x HAVING count(*) >= 2",
    "valid_segments": f"""WITH {_S}, m AS (SELECT *, event_type <> 'error' AS ok, row_number() OVER o - sum((event_type <> 'error')::INT) OVER (o ROWS UNBOUNDED PRECEDING) AS g FROM s WINDOW o AS (PARTITION BY uuid ORDER BY t_us)),
r AS (SELECT uuid, g, count(*) AS n, min(t_us) AS from_us, max(t_us) AS to_us FROM m WHERE ok GROUP BY ALL) SELECT uuid, (row_number() OVER (PARTITION BY uuid ORDER BY g) - 1)::INT AS segment, n, from_us, to_us FROM r""",
    "path_gradient": f"WITH {_S}, l AS (SELECT uuid, t_us, x, lag(x) OVER o AS b, lead(x) OVER o AS a FROM s WINDOW o AS (PARTITION BY uuid ORDER BY t_us)) SELECT uuid, t_us, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a - b) / 2 ELSE coalesce(a - x, x - b) END AS slope FROM l",
    "per_class_quota": f"WITH {BEST} SELECT run_id, shard_no, classes, uuid FROM (SELECT *, row_number() OVER (PARTITION BY run_id, shard_no, classes ORDER BY loaded_at NULLS FIRST, uuid) AS k FROM best WHERE verdict = 'Special') WHERE k <= 3",
    "chunking": f"WITH {_CLIPS} SELECT uuid, (row_number() OVER (ORDER BY uuid) - 1) // 100 AS chunk_no FROM clips",
    "shard_stride_antijoin": f"WITH {_CLIPS}, {_CUR.format('cur', 'labels_store')} SELECT uuid FROM (SELECT uuid, row_number() OVER (ORDER BY uuid) - 1 AS k FROM clips) WHERE k % 4 = 1 AND uuid NOT IN (SELECT uuid FROM cur)",
    "text_fingerprint": "SELECT doc_id, substr(sha256(text), 1, 10) AS print FROM documents",
    "index_fingerprint": "SELECT source, count(*) AS n, max(edited_at) AS last FROM documents GROUP BY source",
    "index_last_wins": "SELECT page_id, arg_max(doc_id, rev_no) AS doc_id FROM documents GROUP BY page_id",
    "source_priority": "SELECT page_id, first(doc_id ORDER BY CASE source WHEN 'live_feed' THEN 1 WHEN 'mirror_b' THEN 2 ELSE 3 END, doc_id) AS doc_id FROM documents GROUP BY page_id",
    "config_diff": """WITH r AS (SELECT run_id, max(n_frames)::VARCHAR AS f, max(shard_no)::VARCHAR AS s FROM clip_results GROUP BY run_id), l AS (SELECT run_id, f, s, lag(f) OVER o AS pf, lag(s) OVER o AS ps, row_number() OVER o AS k FROM r WINDOW o AS (ORDER BY run_id)),
u AS (SELECT run_id, 'frames' AS key, pf AS old, f AS new FROM l WHERE k > 1 UNION ALL SELECT run_id, 'shards', ps, s FROM l WHERE k > 1)
SELECT *, CASE WHEN old IS NULL THEN 'unverified' ELSE 'changed' END AS state FROM u WHERE old IS DISTINCT FROM new""",
    "attention_ratio": f"""WITH {_CELLS}, p AS (SELECT tok, layer, bucket, v / (sum(v) OVER (PARTITION BY tok, layer) + 1e-12) AS p FROM cells WHERE layer >= {LAYERS - LAYERS // 4}), a AS (SELECT tok, bucket, avg(p) AS share FROM p GROUP BY ALL)
SELECT tok, bucket, round(share / (avg(share) OVER (PARTITION BY bucket) + 1e-12), 4) AS ratio FROM a""",
    "spatial_means": f"WITH {_CELLS} SELECT grp, bucket, avg(v) AS mean FROM cells GROUP BY ALL",
    "sink_mask": f"WITH {_CELLS}, {_SINK} SELECT * FROM m",
    "sink_summary": f"WITH {_CELLS}, {_SINK} SELECT layer, count(*) FILTER (is_sink) AS n_sinks, count(*) AS n_buckets FROM m GROUP BY layer",
    "decision_margin": "WITH s AS (SELECT label, list_reverse_sort(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS t FROM embeddings) SELECT label, min(t[1] - t[2]) AS margin_min, avg(t[1] - t[2]) AS margin_mean, count(*) FILTER (t[1] - t[2] < 0.1) AS n_close, count(*) AS n FROM s GROUP BY label",
}

_VIEW = f"""WITH {_EV}, {_CUR.format("cur", "labels_store")}, {_CLIPS}, {_STATE},
f AS (SELECT uuid, arg_min(updated_at, (rev, updated_at)) AS created_at FROM ev GROUP BY uuid),
w AS (SELECT uuid, labeler.id AS who, min(rev) AS t, min(updated_at) FILTER (rev = mr) AS u FROM (SELECT *, min(rev) OVER (PARTITION BY uuid, labeler.id) AS mr FROM ev) GROUP BY ALL),
a AS (SELECT uuid, first(who ORDER BY t, u) AS created_by, string_agg(who, '|' ORDER BY t, who) AS authors FROM w GROUP BY uuid),
q AS (SELECT 'clip' || event_id % 40 AS uuid, user_id::VARCHAR AS user_id, ts, event_id FROM events WHERE ts <= TIMESTAMP '2024-01-16'),
cl AS (SELECT l.uuid, l.user_id FROM (SELECT uuid, arg_max(user_id, event_id) AS user_id, max(event_id) AS event_id, arg_max(ts, event_id) AS ts FROM q GROUP BY uuid) l
  JOIN (SELECT user_id, arg_max(uuid, event_id) AS newest FROM q GROUP BY user_id) o ON o.user_id = l.user_id AND newest = l.uuid WHERE ts + INTERVAL 90000 SECOND >= TIMESTAMP '2024-01-16'),
n AS (SELECT uuid, (SELECT min(store_id) FROM assignments) AS store_id, ((row_number() OVER (ORDER BY uuid) - 1) // 100)::BIGINT AS chunk FROM clips)
SELECT n.uuid, n.store_id, n.chunk, cur.uuid IS NOT NULL AS labeled, coalesce(cur.rev, 0) AS rev, coalesce(cur.labeler.name, cur.labeler.id) AS labeler, created_by, created_at, cur.updated_at, authors, cl.user_id AS claimed_by, st.user_id AS assignee
FROM n LEFT JOIN cur ON cur.uuid = n.uuid LEFT JOIN f ON f.uuid = n.uuid LEFT JOIN a ON a.uuid = n.uuid LEFT JOIN cl ON cl.uuid = n.uuid LEFT JOIN st ON st.store_id = n.store_id AND st.chunk = n.chunk"""
SQL |= {name: SQL[name].replace("(VIEW)", f"({_VIEW})") for name in ("clip_view", "user_counts")}
SQL["ego_described"] = SQL["ego_described"].replace("SUMMARY", f"sm AS ({SQL['ego_summary']})")
