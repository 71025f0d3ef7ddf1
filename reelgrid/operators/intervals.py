"""Merging overlapping intervals into periods and listing the gaps (problem 5).

A mergeable aggregate: its state is a sorted list of disjoint, not touching intervals.
Two states combine by one linear merge, in any order and grouping, so states are combined
in a tree: within each task as spans are read, then by key and one of `FAN` shares of the
tasks, then by key.  A key that holds a third of all rows reaches the last step as at most
`FAN` lists, each no longer than the key's own result.  The last step emits each list and
its complement.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.session import shuffle_width

#: Shares into which a key's lists are divided before they meet.
FAN = 8
#: Intervals that a task holds before it passes them on.
FLUSH = 200_000
#: Rows that the taxonomy may have.
MAX_CLASSES = 10_000
LIST = pa.list_(pa.int64())
_STATE = "uuid string, class_name string, starts array<bigint>, ends array<bigint>"

_UNIT = r"\s*(?:s|sec|secs|seconds)?\s*"
_TIME = r"(?:\d+:)?\d+(?:\.\d+)?"
_ONE = re.compile(rf"\s*(?P<sign>-?)\s*(?P<time>{_TIME}){_UNIT}", re.I)
_TWO = re.compile(rf"\s*(?:from\s+)?(-?{_TIME}){_UNIT}(?:-|–|—|to|until|\.\.)\s*(-?{_TIME}){_UNIT}", re.I)

Intervals = list[tuple[int, int]]


def merge(a: Intervals, b: Intervals) -> Intervals:
    """Two sorted lists of disjoint intervals as one; what touches becomes one interval."""
    if not a or not b:
        return a or b
    out: Intervals = []
    i = j = 0
    s, e = min(a[0], b[0])
    while i < len(a) or j < len(b):
        if j == len(b) or (i < len(a) and a[i] <= b[j]):
            x, y = a[i]
            i += 1
        else:
            x, y = b[j]
            j += 1
        if x <= e:
            e = max(e, y)
        else:
            out.append((s, e))
            s, e = x, y
    out.append((s, e))
    return out


def reduce_tree(lists: list[Intervals]) -> Intervals:
    """Many lists as one, merged in pairs, so each interval is touched log2(n) times."""
    while len(lists) > 1:
        lists = [merge(lists[k], lists[k + 1]) if k + 1 < len(lists) else lists[k] for k in range(0, len(lists), 2)]
    return lists[0] if lists else []


def parse_time(v: object) -> int | None:
    """Milliseconds of seconds or m:ss, as number or text; None if negative, no time, or more than a long holds."""
    if isinstance(v, str):
        m = _ONE.fullmatch(v)
        if not m or m["sign"]:
            return None
        minutes, _, seconds = m["time"].rpartition(":")
        v = float(minutes or 0) * 60 + float(seconds)
    if isinstance(v, bool) or not isinstance(v, int | float):
        return None
    return round(v * 1000) if 0 <= v < 2**63 / 1000 else None


#: A span as written: its start, end and score.
Written = tuple[object, object, object]


def written_spans(v: object, ends_of: Callable[[str], tuple | None], arity: Callable[[int], int], inner: Callable[[int], int]) -> Iterator[Written]:
    """The spans of one class in any of the forms in which answers hold them.

    A span is an object with its ends, a text with two times (ends_of), or a list.  A list of
    lists, objects and such texts holds spans; another one is cut into pieces of arity values
    (0: it holds no span).  inner is the arity of a list within a list.
    """
    if isinstance(v, str):
        v = ends_of(v) or ()
    if isinstance(v, dict):
        yield v.get("start"), v.get("end"), next((v[k] for k in SCORE_KEYS if k in v), None)
    elif isinstance(v, list) and any(isinstance(x, list | dict) or (isinstance(x, str) and ends_of(x)) for x in v):
        for x in v:
            if isinstance(x, list | dict | str):
                yield from written_spans(x, ends_of, inner, inner)
    elif isinstance(v, tuple | list):
        step = arity(len(v))
        for k in range(0, len(v) - step + 1, step) if step else ():
            yield v[k], v[k + 1], v[k + 2] if step > 2 else None


#: Keys that may hold a span's score.
SCORE_KEYS = ("score", "level", "risk")


def _two_times(text: str) -> tuple | None:
    m = _TWO.fullmatch(text)
    return m and m.groups()


def parse_spans(v: object) -> Intervals:
    """The spans of one class, in any of the written forms, as (start, end) in milliseconds."""
    each = written_spans(v, _two_times, lambda n: 3 if n % 3 == 0 else 2, lambda n: n if n in (2, 3) else 0)
    times = ((parse_time(a), parse_time(b)) for a, b, _ in each)
    return [(min(x), max(x)) for x in times if None not in x and x[0] != x[1]]


def parse_time_spans(text: str | None) -> Iterator[tuple[str, Intervals]]:
    """Class name as written and its spans; nothing for null or broken JSON."""
    if not text:
        return
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return
    if isinstance(found, dict):
        for name, spans in found.items():
            yield name, parse_spans(spans)
    elif isinstance(found, list):
        for x in found:
            if isinstance(x, dict):
                name = next((x[k] for k in ("type", "class", "name") if isinstance(x.get(k), str)), None)
                spans = next((x[k] for k in ("spans", "time") if x.get(k) is not None), None)
                if name is not None:
                    yield name, parse_spans(spans)


def coalesce(spans: Iterable[tuple[int, int]]) -> Intervals:
    """Any intervals as a sorted list of disjoint ones."""
    out: Intervals = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _batch(state: dict[tuple[str, str], Intervals]) -> pa.RecordBatch:
    keys, lists = list(state), list(state.values())
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([[s for s, _ in x] for x in lists], LIST), pa.array([[e for _, e in x] for x in lists], LIST)],
        names=["uuid", "class_name", "starts", "ends"],
    )


def _read(names: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[str, str], Intervals] = {}
        held = 0
        for b in batches:
            fresh: dict[tuple[str, str], list] = {}
            for uuid, text in zip(b.column("uuid").to_pylist(), b.column("time_spans").to_pylist(), strict=True):
                for name, spans in parse_time_spans(text):
                    if spans and (known := names.get(name.strip().lower())):
                        fresh.setdefault((uuid, known), []).extend(spans)
            for key, spans in fresh.items():
                old = state.get(key, [])
                state[key] = merge(old, coalesce(spans))
                held += len(state[key]) - len(old)
            if held > FLUSH:
                yield _batch(state)
                state, held = {}, 0
        if state:
            yield _batch(state)

    return run


def _lists(b: pa.RecordBatch) -> Iterator[tuple[tuple[str, str], Intervals]]:
    for u, c, s, e in zip(*(b.column(x).to_pylist() for x in ("uuid", "class_name", "starts", "ends")), strict=True):
        yield (u, c), list(zip(s, e, strict=True))


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, str], Intervals]]:
    """Rows sorted by key: each key's lists as one, with at most log2(n) lists held."""
    now, stack = None, []
    for b in batches:
        for key, spans in _lists(b):
            if key != now:
                if now is not None:
                    yield now, reduce_tree([x for _, x in reversed(stack)])
                now, stack = key, []
            level = 0
            while stack and stack[-1][0] == level:
                spans = merge(stack.pop()[1], spans)
                level += 1
            stack.append((level, spans))
    if now is not None:
        yield now, reduce_tree([x for _, x in reversed(stack)])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict[tuple[str, str], Intervals] = {}
    held = 0
    for key, spans in _by_key(batches):
        state[key] = spans
        held += len(spans)
        if held > FLUSH // 4:
            yield _batch(state)
            state, held = {}, 0
    if state:
        yield _batch(state)


def read_spans(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """First states: uuid, class_name, starts, ends, merged within each task.

    Class names compare without letter case and outer white space; the taxonomy, which is
    read to the driver, is a list of class names of at most MAX_CLASSES (checked).
    """
    classes = taxonomy.select("class_name").where("class_name IS NOT NULL").limit(MAX_CLASSES + 1).collect()
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    names = {r.class_name.strip().lower(): r.class_name for r in classes}
    found = rows.select("uuid", "time_spans").where("time_spans IS NOT NULL AND uuid IS NOT NULL AND time_spans NOT IN ('', '{}', '[]')")
    return found.mapInArrow(_read(names), _STATE)


def combine(states: DataFrame) -> DataFrame:
    """One state for each key."""
    width = shuffle_width(states.sparkSession)
    shared = states.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    first = shared.repartition(width, "uuid", "class_name", "share").sortWithinPartitions("uuid", "class_name").drop("share").mapInArrow(_join, _STATE)
    return first.repartition(width, "uuid", "class_name").sortWithinPartitions("uuid", "class_name").mapInArrow(_join, _STATE)


def periods_and_gaps(states: DataFrame) -> DataFrame:
    """uuid, class_name, kind, start_ms, end_ms: each list and its complement between its ends."""
    at = lambda c, i: F.element_at(c, i)
    whole = F.transform("starts", lambda s, i: F.struct(F.lit("period").alias("kind"), s.alias("start_ms"), at("ends", i + 1).alias("end_ms")))
    between = F.transform(F.slice("starts", F.lit(2), F.size("starts")), lambda s, i: F.struct(F.lit("gap").alias("kind"), at("ends", i + 1).alias("start_ms"), s.alias("end_ms")))
    return states.select("uuid", "class_name", F.explode(F.concat(whole, between)).alias("x")).select("uuid", "class_name", "x.kind", "x.start_ms", "x.end_ms")


def span_periods(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Periods and gaps of each clip and class over all its rows.

    Rows without uuid, spans without class of the taxonomy, broken JSON, and spans with a
    negative, missing or non-numeric end or of no length don't count; repeated rows don't
    matter; empty tables give no rows.
    """
    return periods_and_gaps(combine(read_spans(rows, taxonomy)))
