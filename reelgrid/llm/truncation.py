"""Texts of which the end was lost (problem 4), in SQL.

Word trigrams are counted inside texts and at their ends.  A text is a candidate if its
last trigram is frequent inside texts but almost never their end.  Where a last trigram is
too rare to tell, its last two words, then its last word decide.  A last word that is hardly
a word of its own there counts the longer words that begin with it as inside, as it is a broken
one.  An end that no text has inside isn't a case by the trigrams.  A text counts itself out, and so do its copies: as an end, a text of more than TERSE
words counts once however often it stands.  Shorter ones ("no", "score = 0") count each time,
as it is their repetition that shows them to be whole.

An object that is never closed is cut for certain if it begins as JSON does and has more
opening than closing braces, so such answers come out without the trigram test and aren't
ends.  Those with as many closing ones may be whole, the last brace hidden by a wrong quote,
and go through the test; those that don't begin so are prose.

Trigrams are counted apart in an answer's JSON object, in the object's last string and in
prose, as a sentence's end is a good end for prose, but not inside an object.  An exact
check follows: a candidate is kept unless its object is closed and its last string and
its prose end as sentences do.  What was put after a break (ellipses, fences, closing
tags) is taken off first; an ellipsis stays where texts have it inside as well.

Counts are summed before they are shuffled, and two and one word counts are sums of
trigram counts.  Only last trigrams of answers that fail the exact check are joined, so
endings that many whole answers share never meet in one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from reelgrid.session import cut

#: Share of ends up to which a trigram is almost never terminal, and counts that can tell.
TERMINAL_SHARE = 0.2
ENOUGH = 5
#: Other texts that are enough where they all end so and none has it inside.
ALONE = 2
#: Words up to which each copy of a text counts as an end.
TERSE = 12
#: Times that texts must have an ellipsis inside for it to be a proper end.
NATURAL = 3

_WORDS = r"""regexp_extract_all(lower(regexp_replace({}, r'\p{{N}}+', '0')), r'[\p{{L}}\p{{M}}]+|0|\.\.\.|[^\s\p{{L}}\p{{M}}\p{{N}}]', 0)"""
#: What may follow the end of an answer or a break: fences, tags, and marks of omission.
#: It is read from the end of the text backwards, each piece once and never given up again,
#: so that time and stack don't grow with the number of blanks.
_AFTER = r"""r'^(?:[\s`…]++|>?+[a-z]*+/?+<|\]…\[|\]\.\.\.\[)++'"""
_DOTS = r"""r'^(?:\s++|\.\.\.)++'"""
_BEFORE = r"""r'^(?:\s++|`{3}|</?[a-z]++>)++'"""

#: How a JSON object begins, up to any place where it may be cut.
_BEGINS = r"""r'(?s)^\{\s*("[^"]*("\s*([:=].*)?)?|\x27[^\x27]*(\x27\s*([:=].*)?)?)?$'"""

_PARTS = rf"""
SELECT id, source, raw, start,
  CASE WHEN start > 0 AND closed > 0 THEN substring(raw, start, closed) WHEN start > 0 THEN substring(raw, start) END AS object,
  start > 0 AND closed = 0 AS open,
  CASE WHEN start = 0 THEN raw WHEN closed > 0 THEN substring(raw, start + closed) ELSE '' END AS prose
FROM (
  SELECT *, IF(start = 0, 0, aggregate(
      regexp_extract_all(substring(masked, start), r'(?s)[^"{{}}]+|["{{}}]', 0),
      named_struct('quoted', false, 'depth', 0, 'seen', 0, 'end', 0),
      (s, x) -> IF(s.end > 0, s, named_struct(
        'quoted', IF(x = '"', NOT s.quoted, s.quoted),
        'depth', s.depth + CASE WHEN s.quoted THEN 0 WHEN x = '{{' THEN 1 WHEN x = '}}' THEN -1 ELSE 0 END,
        'seen', s.seen + length(x),
        'end', IF(x = '}}' AND NOT s.quoted AND s.depth = 1, s.seen + 1, 0))),
      s -> s.end)) AS closed
  FROM (
    SELECT id, source, raw, masked, regexp_instr(masked, r'\{{(?=\s*(["\x27}}]|\z))') AS start
    FROM (SELECT id, source, raw, regexp_replace(raw, r'(?s)\\.', '__') AS masked FROM ANSWERS WHERE raw IS NOT NULL AND raw RLIKE r'\S')))
"""


def _trimmed(text: str, mark: str = _AFTER) -> str:
    """SQL: text without what follows its end; mark is a pattern of the text read backwards."""
    return f"reverse(regexp_replace(reverse({text}), {mark}, ''))"


def _streams(parts: str) -> str:
    """Streams of an answer: 1 its object, 2 the object's last string, 3 its prose; open: it stops inside, sure: certainly."""
    last = r"""regexp_extract(regexp_replace(object, r'(?s)\\.', '__'), r'"([^"]*+)"[,\s]*+\}$', 1)"""
    more = "length(replace(object, '}', '')) > length(replace(object, '{', ''))"
    return rf"""
SELECT id, source, inline(transform(parts, (p, i) -> named_struct('no', p.no, 'text', p.text, 'open', p.open, 'sure', p.open AND more, 'last', i = size(parts) - 1)))
FROM (
  SELECT id, source, coalesce({more}, false) AS more, filter(array(
      named_struct('no', 1, 'text', IF(open, {_trimmed("object")}, object), 'open', open AND {_trimmed("object")} RLIKE {_BEGINS}),
      named_struct('no', 2, 'text', IF(open, NULL, {_trimmed(last)}), 'open', false),
      named_struct('no', 3, 'text', {_trimmed(f"regexp_replace(prose, {_BEFORE}, '')")}, 'open', false)),
    p -> p.text IS NOT NULL AND (p.text <> '' OR p.open)) AS parts
  FROM ({parts}))"""


def _three(words: str, i: str) -> str:
    return f"named_struct('a', coalesce(try_element_at({words}, ({i}) - 2 + IF(({i}) > 2, 0, 99999999)), '^'), 'b', coalesce(try_element_at({words}, ({i}) - 1 + IF(({i}) > 1, 0, 99999999)), '^'), 'c', coalesce(try_element_at({words}, {i}), '^'))"


def _tails(streams: str) -> str:
    """Streams as words with their last trigram, and without an ellipsis at the end (shorter); ended: as a sentence does."""
    words, ended = _WORDS.format("text"), r"""RLIKE r'[.!?。！।؟]["\x27”’»)\]\s]*+$'"""
    return rf"""
SELECT id, source, no, open, sure, last, words, dots, {_three("words", "size(words)")} AS g3, {_three("shorter", "size(shorter)")} AS shorter,
  IF(size(words) > {TERSE}, xxhash64(text), NULL) AS copy, text {ended} AS ended, cut_text {ended} AS ended_shorter
FROM (SELECT *, IF(dots, {_WORDS.format("cut_text")}, words) AS shorter FROM (
  SELECT *, {_trimmed("text", _DOTS)} AS cut_text, words[size(words) - 1] = '...' AS dots
  FROM (SELECT *, IF(text = '', array('^'), {words}) AS words FROM ({streams})) WHERE size(words) > 0))"""


def _completions(name: str, grams: str, inside: str, ends: str, by: str) -> str:
    """k: how often a longer word that begins with the last word c stands in its place inside texts."""
    return rf"""{name} AS (
  SELECT {by}, substring(c, 1, n) AS c, sum({inside}) AS k FROM (
    SELECT {", ".join(f"g.{x}" for x in by.split(", "))}, g.c, g.{inside}, explode(filter(lens, n -> n < length(g.c))) AS n
    FROM {grams} g JOIN (SELECT {by}, collect_set(length(c)) AS lens FROM {grams} WHERE {ends} > 0 AND c RLIKE r'^\p{{L}}' GROUP BY {by}) l USING ({by})
    WHERE g.{inside} > 0 AND g.c RLIKE r'^\p{{L}}')
  GROUP BY {by}, substring(c, 1, n))"""


def truncated(answers: DataFrame, id: str = "answer_id", source: str = "run_id", text: str = "raw") -> DataFrame:
    """id and source of each text whose end was lost.

    Null and blank texts aren't cases.  Each row is judged, repeated ones too; an empty
    table gives no rows.  Other columns aren't read.
    """
    spark = answers.sparkSession
    view = f"answers_{uuid.uuid4().hex}"
    answers.selectExpr(f"`{id}` AS id", f"`{source}` AS source", f"`{text}` AS raw").createOrReplaceTempView(view)
    # answers are read and split into words once; both countings read what is written here
    cut(spark.sql(_tails(_streams(_PARTS.replace("ANSWERS", view))))).createOrReplaceTempView(f"{view}_tails")

    inside = cut(spark.sql(f"""
SELECT no, g.a, g.b, g.c, count(*) AS n FROM (
  SELECT no, explode(transform(sequence(1, size(words) - 1), i -> {_three("words", "i")})) AS g FROM {view}_tails WHERE size(words) > 1)
GROUP BY no, g.a, g.b, g.c"""))  # fmt: skip
    inside.createOrReplaceTempView(f"{view}_inside")

    # the ellipsis is part of the text where texts have it inside; else it is taken off
    ends = cut(spark.sql(rf"""
SELECT t.id, t.source, t.no, t.last, t.sure, t.copy, IF(t.dots AND k.c IS NULL, t.shorter, t.g3) AS g,
  NOT t.open AND (k.c IS NOT NULL OR IF(t.dots, t.ended_shorter, t.ended)) AS whole
FROM {view}_tails t
LEFT JOIN (SELECT no, a, b, c FROM {view}_inside WHERE c = '...' AND n >= {NATURAL}) k
  ON t.dots AND t.no = k.no AND t.g3.a = k.a AND t.g3.b = k.b AND t.g3.c = k.c"""))  # fmt: skip
    ends.createOrReplaceTempView(f"{view}_ends")

    # counts of inside and end by trigram, last two words and last word
    grams = spark.sql(f"""
SELECT no, a, b, c, sum(i) AS i3, sum(t) AS t3 FROM (
  SELECT no, a, b, c, n AS i, 0L AS t FROM {view}_inside
  UNION ALL SELECT no, g.a, g.b, g.c, 0L, count_if(copy IS NULL) + count(DISTINCT copy) FROM {view}_ends WHERE NOT sure GROUP BY no, g.a, g.b, g.c)
GROUP BY no, a, b, c""")
    cut(grams).createOrReplaceTempView(f"{view}_grams")
    rare = spark.sql(rf"""
WITH g3 AS (SELECT * FROM {view}_grams),
g2 AS (SELECT no, b, c, sum(i3) AS i2, sum(t3) AS t2 FROM g3 GROUP BY no, b, c),
g1 AS (SELECT no, c, sum(i2) AS i1, sum(t2) AS t1 FROM g2 GROUP BY no, c),
{_completions("p3", "g3", "i3", "t3", "no, a, b")},
{_completions("p2", "g2", "i2", "t2", "no, b")},
{_completions("p1", "g1", "i1", "t1", "no")},
e AS (
  SELECT no, a, b, c, t3 - 1 AS t3, t2 - 1 AS t2, t1 - 1 AS t1, {", ".join(f"i{n} + IF(i{n} > {TERMINAL_SHARE} * k{n}, 0, k{n}) AS i{n}" for n in (3, 2, 1))}
  FROM (SELECT no, a, b, c, t3, t2, t1, i3, i2, i1, coalesce(k3, 0) AS k3, coalesce(k2, 0) AS k2, coalesce(k1, 0) AS k1
    FROM g3 JOIN g2 USING (no, b, c) JOIN g1 USING (no, c)
    LEFT JOIN (SELECT no, a, b, c, k AS k3 FROM p3) USING (no, a, b, c)
    LEFT JOIN (SELECT no, b, c, k AS k2 FROM p2) USING (no, b, c)
    LEFT JOIN (SELECT no, c, k AS k1 FROM p1) USING (no, c)
    WHERE t3 > 0))
SELECT no, a, b, c FROM e WHERE CASE
  WHEN i3 + t3 >= {ENOUGH} OR i3 = 0 AND t3 >= {ALONE} THEN t3 <= {TERMINAL_SHARE} * (i3 + t3)
  WHEN i2 + t2 >= {ENOUGH} OR i2 = 0 AND t2 >= {ALONE} THEN t2 <= {TERMINAL_SHARE} * (i2 + t2)
  ELSE i1 > 0 AND t1 <= {TERMINAL_SHARE} * (i1 + t1) END""")
    rare.createOrReplaceTempView(f"{view}_rare")
    return spark.sql(f"""
SELECT e.id AS `{id}`, e.source AS `{source}` FROM {view}_ends e LEFT SEMI JOIN {view}_rare r
  ON e.no = r.no AND e.g.a = r.a AND e.g.b = r.b AND e.g.c = r.c
WHERE e.last AND NOT e.whole AND NOT e.sure
UNION ALL SELECT id, source FROM {view}_ends WHERE sure""")  # fmt: skip


def truncation_rates(answers: DataFrame, id: str = "answer_id", source: str = "run_id", text: str = "raw") -> DataFrame:
    """source, n (its texts), n_truncated and share; a null source is a source."""
    found = truncated(answers, id, source, text).groupBy(source).agg({"*": "count"}).withColumnsRenamed({source: "of", "count(1)": "k"})
    every = answers.groupBy(source).agg({"*": "count"}).withColumnRenamed("count(1)", "n")
    joined = every.join(found, every[source].eqNullSafe(found["of"]), "left")
    return joined.selectExpr(f"`{source}`", "n", "coalesce(k, 0) AS n_truncated", "coalesce(k, 0) / n AS share")
