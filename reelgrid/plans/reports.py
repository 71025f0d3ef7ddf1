"""Queries of distributions, search, model texts and rechecks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import answers, chunks, packed
from reelgrid.functions.text import key_text
from reelgrid.operators import aggregate as ag
from reelgrid.operators import evaluate as ev
from reelgrid.operators import recheck, search
from reelgrid.plans.evaluation import BEST, LAB, OWN, PAIRS
from reelgrid.session import table


TEXTS = ("observation", "ego_behavior", "unusual_elements", "score_reason")


def _best(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Best rows with only these columns beside what chooses them, as all that is kept is shuffled."""
    return ev.best_results(table(spark, sf, "clip_results").select(*dict.fromkeys(["run_id", "uuid", "shard_no", "loaded_at", "n_frames", *columns])))


def _tax(spark: SparkSession, sf: str) -> ev.Taxonomy:
    return ev.Taxonomy.of(table(spark, sf, "taxonomy"))


def parse_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Group scores of each delivered row, one row for each key."""
    df = table(spark, sf, "clip_results").select("run_id", "uuid", "shard_no", "loaded_at", F.explode(packed.packed_entries(F.col("group_scores"))).alias("e"))
    return df.select("run_id", "uuid", "shard_no", "loaded_at", "e.k", "e.v")


def parse_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Recheck answers read from the model's text."""
    return table(spark, sf, "recheck_answers").select("answer_id", answers.parse_answer(F.col("raw")).alias("a")).select("answer_id", "a.*")


def tier_score(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest group score of each clip and run that lies on the scale."""
    m = packed.parse_packed(F.col("group_scores"))
    return _best(spark, sf, "group_scores").select("run_id", "uuid", F.array_max(F.filter(F.map_values(m), lambda v: v.between(0, 4))).alias("tier"))


def slug_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the taxonomy's groups and classes."""
    return table(spark, sf, "taxonomy").select("class_name", packed.slug(F.col("group_name")).alias("group_key"), packed.slug(F.col("class_name")).alias("class_key"))


def chunk_parse(spark: SparkSession, sf: str) -> DataFrame:
    """How many numbers each event's chunk list names, the least, the greatest and their sum (null beyond a long)."""
    df = table(spark, sf, "assignments").select("event_id", "received_at", chunks.merged(chunks.ranges(F.col("chunks"))).alias("rs")).where("size(rs) > 0")
    count = lambda r: r["hi"] - r["lo"] + 1
    half = lambda r: F.when(count(r) % 2 == 0, F.try_multiply(F.expr("1L") * (count(r) / 2).cast("bigint"), F.try_add(r["lo"], r["hi"]))).otherwise(F.try_multiply(count(r), r["lo"] + ((r["hi"] - r["lo"]) / 2).cast("bigint")))
    zero = F.lit(0).cast("bigint")
    n, total = F.aggregate("rs", zero, lambda a, r: F.try_add(a, count(r))), F.aggregate("rs", zero, lambda a, r: F.try_add(a, half(r)))
    return df.select("event_id", "received_at", n.try_cast("int").alias("n"), F.col("rs")[0]["lo"].alias("least"), F.element_at("rs", -1)["hi"].alias("greatest"), total.alias("total"))


def chunk_format(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk lists in their plain form."""
    df = table(spark, sf, "assignments").select("event_id", "received_at", chunks.merged(chunks.ranges(F.col("chunks"))).alias("rs")).where("size(rs) > 0")
    return df.select("event_id", "received_at", chunks.format_ranges(F.col("rs")).alias("spec"))


def coerce_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores as the model wrote them in its answers, as integers on the scale."""
    v = answers.strict_json(answers.json_block(F.col("raw")))
    text = F.try_variant_get(v, "$.score", "string")
    return table(spark, sf, "recheck_answers").select("answer_id", text.alias("written")).where("written IS NOT NULL").select("answer_id", packed.leading_score(F.col("written")).alias("score"))


def distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of each score by run."""
    return ag.distribution(ag.rated(_best(spark, sf, *ev.AXES, "tier_score")))


def score_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and shares of each score's values by run."""
    return ag.score_counts(ag.rated(_best(spark, sf, *ev.AXES, "tier_score")))


def class_frequency_cli(spark: SparkSession, sf: str) -> DataFrame:
    """How often each class is written."""
    return ag.class_frequency(_best(spark, sf, "classes"), _tax(spark, sf))


def class_frequency_gui(spark: SparkSession, sf: str) -> DataFrame:
    """How many clips have each class."""
    return ag.class_frequency(_best(spark, sf, "classes"), _tax(spark, sf), distinct=True)


def classes_per_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram of the number of classes."""
    return ag.classes_per_clip(_best(spark, sf, "classes"))


def cooccur_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Most frequent pairs of classes by run."""
    return ag.cooccurring(_best(spark, sf, "classes"))


def overview(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of each run."""
    return ag.overview(_best(spark, sf, "classes", "parse_ok"))


def search_mining(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with a class of two, a score of 2 and more and a view that isn't clear."""
    return search.search_results(_best(spark, sf, "classes", "group_scores", *ev.AXES, *TEXTS), search.Facets(classes=("Roadworks", "Walker in lane"), score=(2, 4), axes={"atmospheric_obscurants": (1, None)}, limit=300)).select("run_id", "uuid", F.array_join("names", "|").alias("names"), "score_max")


def search_text(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions without Roadworks whose texts speak of the lane."""
    return search.search_results(_best(spark, sf, "classes", "group_scores", *ev.AXES, *TEXTS), search.Facets(text="LANE", classes=("Roadworks",), mode="none", special="special", limit=None)).select("run_id", "uuid", "score_max")


def search_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with scores of 1 and more in dim light."""
    return search.search_labels(ev.current_labels(table(spark, sf, "labels_store")), search.Facets(score=(1, 4), axes={"illumination": (1, 3)}, limit=None)).select("uuid", "score_max")


def search_false_positives(spark: SparkSession, sf: str) -> DataFrame:
    """Labels for which one run predicted a class too many."""
    run = _best(spark, sf, "classes").where("run_id = '20260614_093000_full'").select("uuid", packed.split_classes(F.col("classes")).alias("pred"))
    return search.search_labels(ev.current_labels(table(spark, sf, "labels_store")), search.Facets(outcome="fp", limit=None), run).select("uuid", F.array_join("names", "|").alias("names"))


def recheck_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Clips and classes to ask about."""
    return recheck.candidates(_best(spark, sf, "classes", "parse_ok", "observation", "ego_behavior", "unusual_elements"), table(spark, sf, "taxonomy"))


def recheck_open(spark: SparkSession, sf: str) -> DataFrame:
    """Clips and classes to ask about that have no answer yet."""
    return recheck.open_questions(_best(spark, sf, "classes", "parse_ok", "observation", "ego_behavior", "unusual_elements"), table(spark, sf, "taxonomy"), table(spark, sf, "recheck_answers"))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """The taxonomy with patterns that occur in the test texts."""
    words = F.when(F.col("class_pos") == 0, F.array(F.lit("lane narrows"), F.lit("car ?park"))).when(F.col("class_pos") == 1, F.array(F.lit("Rain|dim lights"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "taxonomy").withColumn("recheck_keywords", words)


def recheck_by_words(spark: SparkSession, sf: str) -> DataFrame:
    """Clips and classes to ask about, by patterns of our own."""
    return recheck.candidates(_best(spark, sf, "classes", "parse_ok", "observation", "ego_behavior", "unusual_elements"), _words(spark, sf))


def recheck_by_words_open(spark: SparkSession, sf: str) -> DataFrame:
    """These without those that have an answer."""
    return recheck.open_questions(_best(spark, sf, "classes", "parse_ok", "observation", "ego_behavior", "unusual_elements"), _words(spark, sf), table(spark, sf, "recheck_answers"))


def run_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled clips that one run lacks."""
    return ev.missing_clips(table(spark, sf, "clip_results").where("run_id = '20260614_093000_full'"), table(spark, sf, "labels_store"))


def recheck_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Results with the answers worked in."""
    columns = ("verdict", "n_classes", "classes", "group_scores", "field_scores", "tier_score", "score_reason")
    return recheck.apply_answers(_best(spark, sf, *columns), table(spark, sf, "recheck_answers"), own=OWN).select("run_id", "uuid", *columns)


def fold_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Group scores as they follow from scores by field."""
    rows = _best(spark, sf, "field_scores", "classes").where("field_scores IS NOT NULL")
    folded = ev.folded_scores(packed.parse_packed(F.col("field_scores")), packed.split_classes(F.col("classes")), _tax(spark, sf), OWN)
    return rows.select("run_id", "uuid", F.explode(folded).alias("name", "score"))


def search_all_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions that have both of two classes."""
    found = search.search_results(_best(spark, sf, "classes", "group_scores", *ev.AXES, *TEXTS), search.Facets(classes=("Walker in lane", "Roadworks"), mode="all", limit=None))
    return found.select("run_id", "uuid", F.array_join("names", "|").alias("names"), "score_max", *ev.AXES)


def search_total(spark: SparkSession, sf: str) -> DataFrame:
    """How many predictions fit a search whose list is cut, by run."""
    return search.totals(_best(spark, sf, "classes", "group_scores", *ev.AXES, *TEXTS), search.Facets(classes=("Roadworks", "Walker in lane"), score=(2, 4), axes={"atmospheric_obscurants": (1, None)}, limit=300))


def _outcome(spark: SparkSession, sf: str, wanted: str) -> DataFrame:
    run = _best(spark, sf, "classes").where("run_id = '20260614_093000_full'").select("uuid", packed.split_classes(F.col("classes")).alias("pred"))
    found = search.search_labels(ev.current_labels(table(spark, sf, "labels_store")), search.Facets(outcome=wanted, limit=None), run)
    return found.select("uuid", F.array_join("names", "|").alias("names"), "score_max", "note")


def search_true_positives(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with classes for which one run predicted some too."""
    return _outcome(spark, sf, "tp")


def search_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of which one run missed a class."""
    return _outcome(spark, sf, "fn")


def clip_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Every prediction beside its label."""
    best = _best(spark, sf, "classes", "tier_score", "score_reason").withColumn("uuid", key_text(F.col("uuid")))
    found = search.details(best, ev.current_labels(table(spark, sf, "labels_store").select("uuid", "rev", "updated_at", "class_list")))
    return found.withColumns({"truth": F.array_join("truth", "|"), "names": F.array_join("names", "|")})


def show_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions worth showing."""
    return search.worth_showing(_best(spark, sf, "verdict", "tier_score")).select("run_id", "uuid", "tier_score")


def score_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Scores that a model is asked for."""
    return ev.score_fields(table(spark, sf, "taxonomy"), OWN)


_ALL = (parse_packed, parse_answers, tier_score, slug_keys, chunk_parse, chunk_format, coerce_scores, distribution, score_counts, class_frequency_cli, class_frequency_gui, classes_per_clip, cooccur_topk, overview, search_mining, search_text, search_labels, search_false_positives, recheck_candidates, recheck_open, recheck_apply, fold_fields, search_all_classes, search_total, search_true_positives, search_misses, clip_detail, show_selection, score_fields, recheck_by_words, recheck_by_words_open, run_gaps)
QUERIES = {f.__name__: f for f in _ALL}

_KV = """parts AS (SELECT {0}, unnest(string_split(coalesce(group_scores, ''), '|')) AS part, unnest(range(len(string_split(coalesce(group_scores, ''), '|')))) AS i FROM {1}),
kv AS (SELECT {0}, trim(regexp_extract(part, '^(.*)=([^=]*)$', 1)) AS k, CASE WHEN regexp_full_match(trim(regexp_extract(part, '^(.*)=([^=]*)$', 2)), '[+-]?[0-9]+') THEN trim(regexp_extract(part, '^(.*)=([^=]*)$', 2))::INT END AS v, i FROM parts),
packed AS (SELECT {0}, k, arg_max(v, i) AS v FROM kv WHERE k <> '' AND v IS NOT NULL GROUP BY ALL)"""
_NAMES = "list_filter(list_transform(string_split(coalesce(classes, ''), '|'), lambda x: trim(x)), lambda x: x <> '')"
_RATED = "rated AS (" + " UNION ALL ".join(f"SELECT run_id, '{c}' AS name, {c} AS v FROM best" for c in (*ev.AXES, "tier_score")) + ")"
_CHUNKS = r"""p AS (SELECT event_id, received_at, list_filter(regexp_split_to_array(coalesce(chunks, ''), '[,\s]+'), lambda x: x <> '') AS c FROM assignments),
ok AS (SELECT * FROM p WHERE len(c) > 0 AND len(list_filter(c, lambda x: NOT regexp_full_match(x, '[0-9]+(-[0-9]+)?'))) = 0),
e AS (SELECT event_id, received_at, unnest(c) AS x FROM ok),
n AS (SELECT DISTINCT event_id, received_at, unnest(range(least(split_part(x, '-', 1)::BIGINT, regexp_extract(x, '([0-9]+)$', 1)::BIGINT), greatest(split_part(x, '-', 1)::BIGINT, regexp_extract(x, '([0-9]+)$', 1)::BIGINT) + 1)) AS v FROM e)"""
_FREQ = """WITH {best}, b AS (SELECT run_id, {names} AS cs FROM best), t AS (SELECT run_id, count(*) AS every, count(*) FILTER (len(cs) > 0) AS special FROM b GROUP BY 1),
c AS (SELECT run_id, class_name, count(*) AS n FROM (SELECT run_id, unnest(cs) AS class_name FROM b) GROUP BY ALL),
f AS (SELECT run_id, class_name, max(n) AS n FROM (SELECT * FROM c UNION ALL SELECT run_id, class_name, 0 FROM t, taxonomy) GROUP BY ALL)
SELECT run_id, f.class_name, coalesce(group_name, '') AS group_name, n, n / every AS share_all, coalesce(n / nullif(special, 0), 0) AS share_special FROM f JOIN t USING (run_id) LEFT JOIN taxonomy USING (class_name)"""
_TEXT = "lower(coalesce(observation, '') || ' ' || coalesce(ego_behavior, '') || ' ' || coalesce(unusual_elements, '') || ' ' || coalesce(score_reason, ''))"
_TOP = "(SELECT run_id, uuid, max(v) AS score_max FROM packed GROUP BY ALL)"
_CAND = """cand AS (
  SELECT run_id, uuid, class_name FROM best, taxonomy
  WHERE n_frames > 0 AND parse_ok = 1 AND trim(coalesce(classes, '')) = ''
    AND regexp_matches(coalesce(observation, '') || ' ' || coalesce(unusual_elements, '') || ' ' || coalesce(ego_behavior, ''), '(?i)' || array_to_string(recheck_keywords, '|')))"""
_WORDS = _CAND.replace("FROM best, taxonomy", "FROM best, (SELECT class_name, CASE class_pos WHEN 0 THEN ['lane narrows', 'car ?park'] WHEN 1 THEN ['Rain|dim lights'] END AS recheck_keywords FROM taxonomy WHERE class_pos < 2)")

SQL = {
    "parse_packed": f"WITH {_KV.format('run_id, uuid, shard_no, loaded_at', 'clip_results')} SELECT run_id, uuid, shard_no, loaded_at, k, v FROM packed",
    "parse_answers": "SELECT answer_id, present, score, reason, parse_ok FROM recheck_answers",
    "tier_score": f"WITH {BEST}, {_KV.format('run_id, uuid', 'best')} SELECT b.run_id, b.uuid, max(v) FILTER (v BETWEEN 0 AND 4) AS tier FROM best b LEFT JOIN packed p ON b.run_id = p.run_id AND b.uuid = p.uuid GROUP BY ALL",
    "slug_keys": "SELECT class_name, trim(regexp_replace(lower(group_name), '[^a-z0-9]+', '_', 'g'), '_') AS group_key, trim(regexp_replace(lower(class_name), '[^a-z0-9]+', '_', 'g'), '_') AS class_key FROM taxonomy",
    "chunk_parse": f"WITH {_CHUNKS} SELECT event_id, received_at, count(*)::INT AS n, min(v) AS least, max(v) AS greatest, sum(v)::BIGINT AS total FROM n GROUP BY ALL",
    "chunk_format": f"""WITH {_CHUNKS}, g AS (SELECT *, v - row_number() OVER (PARTITION BY event_id, received_at ORDER BY v) AS island FROM n),
r AS (SELECT event_id, received_at, min(v) AS lo, CASE WHEN min(v) = max(v) THEN min(v)::VARCHAR ELSE min(v) || '-' || max(v) END AS t FROM g GROUP BY event_id, received_at, island)
SELECT event_id, received_at, string_agg(t, ', ' ORDER BY lo) AS spec FROM r GROUP BY ALL""",
    "coerce_scores": """WITH j AS (SELECT answer_id, regexp_extract(raw, '(?s)\\{.*\\}', 0) AS b FROM recheck_answers WHERE parse_ok), s AS (SELECT answer_id, json_extract_string(b, '$.score') AS w FROM j),
n AS (SELECT answer_id, CASE WHEN regexp_full_match(trim(w), '-?[0-9]+(\\.[0-9]+)?') THEN round_even(trim(w)::DOUBLE, 0)::INT WHEN regexp_matches(w, '^\\s*[0-9]+') THEN regexp_extract(w, '^\\s*([0-9]+)', 1)::INT END AS v FROM s WHERE w IS NOT NULL)
SELECT answer_id, CASE WHEN v BETWEEN 0 AND 4 THEN v END AS score FROM n""",
    "distribution": f"WITH {BEST}, {_RATED} SELECT run_id, name, count(v) AS n, count(*) - count(v) AS n_unrated, count(*) FILTER (v NOT BETWEEN 0 AND 4) AS n_outside, avg(v) AS mean, var_pop(v) AS var, stddev_pop(v) AS std, median(v)::DOUBLE AS median, min(v) AS least, max(v) AS greatest FROM rated GROUP BY ALL",
    "score_counts": f"""WITH {BEST}, {_RATED}, g AS (SELECT DISTINCT run_id, name, s::INT AS v FROM rated, (SELECT unnest(range(5)) AS s) UNION SELECT run_id, name, v FROM rated WHERE v IS NOT NULL),
t AS (SELECT run_id, name, count(v) AS r, count(*) AS a FROM rated GROUP BY ALL), c AS (SELECT run_id, name, v, count(*) AS n FROM rated GROUP BY ALL)
SELECT g.run_id, g.name, g.v, coalesce(n, 0) AS n, coalesce(n, 0) / nullif(r, 0) AS share_rated, coalesce(n, 0) / a AS share_all FROM g JOIN t USING (run_id, name) LEFT JOIN c ON g.run_id = c.run_id AND g.name = c.name AND g.v = c.v""",
    "class_frequency_cli": _FREQ.format(best=BEST, names=_NAMES),
    "class_frequency_gui": _FREQ.format(best=BEST, names=f"list_distinct({_NAMES})"),
    "classes_per_clip": f"WITH {BEST} SELECT run_id, len({_NAMES})::INT AS n_classes, count(*) AS n FROM best GROUP BY ALL",
    "cooccur_topk": f"""WITH {BEST}, u AS (SELECT DISTINCT run_id, uuid, unnest({_NAMES}) AS c FROM best), p AS (SELECT x.run_id, x.c AS a, y.c AS b, count(*) AS n, min(x.uuid) AS first FROM u x JOIN u y ON x.run_id = y.run_id AND x.uuid = y.uuid AND x.c < y.c GROUP BY ALL)
SELECT run_id, a, b, n, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, first, a, b) AS place FROM p) WHERE place <= 10""",
    "overview": f"WITH {BEST}, b AS (SELECT *, len({_NAMES}) AS k FROM best) SELECT run_id, count(*) AS n, count(*) FILTER (k > 0) AS n_special, count(*) FILTER (k = 0) AS n_normal, count(*) FILTER (coalesce(n_frames, 0) <= 0) AS n_failed, count(*) FILTER (coalesce(parse_ok, 0) <> 1) AS n_unparsed, avg(k) FILTER (k > 0) AS mean_classes FROM b GROUP BY run_id",
    "search_mining": f"""WITH {BEST}, {_KV.format('run_id, uuid', 'best')}
SELECT b.run_id, b.uuid, array_to_string({_NAMES}, '|') AS names, score_max FROM best b LEFT JOIN {_TOP} t ON b.run_id = t.run_id AND b.uuid = t.uuid
WHERE list_has_any({_NAMES}, ['Roadworks', 'Walker in lane']) AND (score_max IS NULL OR score_max BETWEEN 2 AND 4) AND atmospheric_obscurants >= 1
ORDER BY coalesce(score_max, 0) DESC, b.run_id, b.uuid LIMIT 300""",
    "search_text": f"""WITH {BEST}, {_KV.format('run_id, uuid', 'best')}
SELECT b.run_id, b.uuid, score_max FROM best b LEFT JOIN {_TOP} t ON b.run_id = t.run_id AND b.uuid = t.uuid WHERE len({_NAMES}) > 0 AND NOT list_contains({_NAMES}, 'Roadworks') AND contains({_TEXT}, 'lane')""",
    "search_labels": f"""WITH {LAB.replace(" AND class_list IS NOT NULL", "")}, s AS (SELECT u AS uuid, weather, list_max(list_filter(map_values(group_scores), lambda v: v <> -1)) AS score_max FROM lab)
SELECT uuid, score_max FROM s WHERE score_max BETWEEN 1 AND 4 AND weather['illumination'] BETWEEN 1 AND 3""",
    "search_false_positives": f"""WITH {PAIRS} SELECT uuid, array_to_string(gt, '|') AS names FROM pairs WHERE run_id = '20260614_093000_full' AND len(list_filter(pred, lambda x: NOT list_contains(gt, x))) > 0""",
    "recheck_candidates": f"WITH {BEST}, {_CAND} SELECT * FROM cand",
    "recheck_open": f"WITH {BEST}, {_CAND} SELECT * FROM cand ANTI JOIN recheck_answers USING (run_id, uuid, class_name)",
    "recheck_apply": f"""WITH {BEST},
last AS (SELECT *, row_number() OVER (PARTITION BY run_id, uuid ORDER BY answer_id) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, uuid, class_name ORDER BY shard_no DESC NULLS LAST, answered_at DESC NULLS LAST, answer_id DESC) AS r FROM recheck_answers) WHERE r = 1 AND present AND score >= 2),
h AS (SELECT run_id, uuid, list(class_name ORDER BY answer_id) AS cs, string_agg('recheck ' || class_name || ': ' || coalesce(reason, ''), ' | ' ORDER BY answer_id) AS why FROM last GROUP BY ALL),
cell AS (
  SELECT run_id, uuid, 'g' AS what, unnest(string_split(coalesce(group_scores, ''), '|')) AS part, unnest(range(len(string_split(coalesce(group_scores, ''), '|')))) AS i FROM best
  UNION ALL SELECT run_id, uuid, 'f', unnest(string_split(coalesce(field_scores, ''), '|')), unnest(range(len(string_split(coalesce(field_scores, ''), '|')))) FROM best),
kv AS (SELECT run_id, uuid, what, trim(regexp_extract(part, '^(.*)=([^=]*)$', 1)) AS k, i, CASE WHEN regexp_full_match(trim(regexp_extract(part, '^(.*)=([^=]*)$', 2)), '[+-]?[0-9]+') THEN trim(regexp_extract(part, '^(.*)=([^=]*)$', 2))::INT END AS v FROM cell),
old AS (SELECT run_id, uuid, what, k, arg_max(v, i) AS v, min(i) AS i FROM kv WHERE k <> '' AND v IS NOT NULL GROUP BY ALL),
both_ AS (SELECT * FROM old UNION ALL SELECT run_id, uuid, 'g', group_name, score, 1000000 + place FROM last UNION ALL SELECT run_id, uuid, 'f', CASE WHEN class_name = 'Gravel road' THEN class_name ELSE group_name END, score, 1000000 + place FROM last),
new AS (SELECT run_id, uuid, what, k, max(v) AS v, min(i) AS i FROM both_ WHERE k IS NOT NULL GROUP BY ALL),
text AS (SELECT run_id, uuid, string_agg(k || '=' || v, '|' ORDER BY i) FILTER (what = 'g') AS g, string_agg(k || '=' || v, '|' ORDER BY i) FILTER (what = 'f') AS f, max(v) FILTER (what = 'g' AND v BETWEEN 0 AND 4) AS m FROM new GROUP BY ALL),
j AS (SELECT b.*, h.cs, h.why, g, f, m, {_NAMES} AS names FROM best b LEFT JOIN h ON b.run_id = h.run_id AND b.uuid = h.uuid LEFT JOIN text t ON b.run_id = t.run_id AND b.uuid = t.uuid)
SELECT run_id, uuid, CASE WHEN cs IS NULL THEN verdict ELSE 'Special' END AS verdict, CASE WHEN cs IS NULL THEN n_classes ELSE len(list_concat(list_distinct(names), list_filter(cs, lambda x: NOT list_contains(names, x))))::INT END AS n_classes,
  CASE WHEN cs IS NULL THEN classes ELSE array_to_string(list_concat(list_filter(names, lambda x, i: list_position(names, x) = i), list_filter(cs, lambda x: NOT list_contains(names, x))), '|') END AS classes,
  CASE WHEN cs IS NULL THEN group_scores ELSE coalesce(g, '') END AS group_scores, CASE WHEN cs IS NULL THEN field_scores ELSE coalesce(f, '') END AS field_scores,
  CASE WHEN cs IS NULL THEN tier_score ELSE m END AS tier_score, CASE WHEN cs IS NULL THEN score_reason WHEN coalesce(score_reason, '') = '' THEN why ELSE score_reason || ' | ' || why END AS score_reason FROM j""",
    "fold_fields": f"""WITH {BEST}, fb AS (SELECT run_id, uuid, field_scores AS group_scores, {_NAMES} AS names FROM best WHERE field_scores IS NOT NULL), {_KV.format('run_id, uuid', 'fb')}
SELECT p.run_id, p.uuid, coalesce(t.group_name, k) AS name, max(CASE WHEN k = 'Gravel road' AND NOT list_contains(names, k) THEN 0 ELSE v END) AS score
FROM packed p JOIN fb ON p.run_id = fb.run_id AND p.uuid = fb.uuid LEFT JOIN taxonomy t ON t.class_name = k WHERE t.group_name IS NOT NULL OR k IN (SELECT group_name FROM taxonomy) GROUP BY ALL""",
    "search_all_classes": f"""WITH {BEST}, {_KV.format('run_id, uuid', 'best')}
SELECT b.run_id, b.uuid, array_to_string({_NAMES}, '|') AS names, score_max, illumination, precipitation, road_surface, atmospheric_obscurants FROM best b LEFT JOIN {_TOP} t ON b.run_id = t.run_id AND b.uuid = t.uuid WHERE list_has_all({_NAMES}, ['Roadworks', 'Walker in lane'])""",
    "search_total": f"""WITH {BEST}, {_KV.format('run_id, uuid', 'best')}
SELECT b.run_id, count(*) AS n FROM best b LEFT JOIN {_TOP} t ON b.run_id = t.run_id AND b.uuid = t.uuid WHERE list_has_any({_NAMES}, ['Roadworks', 'Walker in lane']) AND (score_max IS NULL OR score_max BETWEEN 2 AND 4) AND atmospheric_obscurants >= 1 GROUP BY b.run_id""",
    "recheck_by_words": f"WITH {BEST}, {_WORDS} SELECT * FROM cand",
    "recheck_by_words_open": f"WITH {BEST}, {_WORDS} SELECT * FROM cand ANTI JOIN recheck_answers USING (run_id, uuid, class_name)",
    "run_gaps": "SELECT DISTINCT lower(trim(uuid)) AS uuid FROM labels_store WHERE class_list IS NOT NULL AND lower(trim(uuid)) NOT IN (SELECT lower(trim(uuid)) FROM clip_results WHERE run_id = '20260614_093000_full')",
    "clip_detail": f"""WITH {BEST}, l AS (SELECT * FROM (SELECT lower(trim(uuid)) AS u, class_list, row_number() OVER (PARTITION BY lower(trim(uuid)) ORDER BY rev DESC, updated_at DESC) AS r FROM labels_store) WHERE r = 1)
SELECT run_id, lower(trim(uuid)) AS uuid, l.u IS NOT NULL AS has_label, CASE WHEN l.u IS NOT NULL THEN array_to_string(list_sort(list_distinct(coalesce(l.class_list, []))), '|') END AS truth, array_to_string({_NAMES}, '|') AS names, tier_score AS tier, score_reason AS reason FROM best b LEFT JOIN l ON l.u = lower(trim(b.uuid))""",
    "show_selection": f"WITH {BEST} SELECT run_id, uuid, tier_score FROM best WHERE verdict = 'Special' AND (tier_score IS NULL OR tier_score >= 2)",
    "score_fields": """WITH f AS (SELECT group_name AS field, group_name, min(group_pos) AS gp, -1 AS cp FROM taxonomy GROUP BY ALL UNION ALL SELECT class_name, group_name, group_pos, class_pos FROM taxonomy WHERE class_name = 'Gravel road')
SELECT field, group_name, (row_number() OVER (ORDER BY gp, cp, field))::INT AS place FROM f""",
    **{
        name: f"""WITH {PAIRS}, s AS (SELECT u, list_max(list_filter(map_values(group_scores), lambda v: v <> -1)) AS score_max, note FROM lab)
SELECT uuid, array_to_string(gt, '|') AS names, score_max, note FROM pairs JOIN s ON s.u = uuid WHERE run_id = '20260614_093000_full' AND {test}"""
        for name, test in (("search_true_positives", "len(gt) > 0 AND len(pred) > 0"), ("search_misses", "len(list_filter(gt, lambda x: NOT list_contains(pred, x))) > 0"))
    },
}
