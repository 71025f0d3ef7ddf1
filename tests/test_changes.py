"""Applying change feeds, against a plain replay, in any order of delivery."""

import random
import re

from pyspark.sql import functions as F

from reelgrid.functions import chunks
from reelgrid.operators import changes

SCHEMA = "event_id string, store_id string, ts string, tie_no int, user_id string, action string, chunks string, removed string, k string, n int"


def replay(events):
    def read(spec):
        parts = [p for p in re.split(r"[,\s]+", spec or "") if p]
        if not all(re.fullmatch(r"[0-9]+(-[0-9]+)?", p) for p in parts):
            return None
        ends = [[int(x) for x in p.split("-")] for p in parts]
        return [c for e in ends for c in range(min(e), max(e) + 1)]

    state = {}
    for e in sorted({x[0]: x for x in events}.values(), key=lambda x: (x[2], x[3])):
        set_, gone = read(e[6]), read(e[7])
        action = (e[5] or "").strip().lower()
        if set_ is None or gone is None or action not in ("assign", "unassign"):
            continue
        for c in gone:
            state.pop((e[1], c), None)
        for c in set_:
            state.pop((e[1], c), None)
            if action == "assign" and e[4] is not None:
                state[(e[1], c)] = e[4]
    return {(s, c, u) for (s, c), u in state.items()}


def run(spark, events, folder):
    df = spark.createDataFrame([(*e, "clash", 1) for e in events], SCHEMA)
    out = [tuple(r) for r in changes.assigned_chunks(df, folder).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_random_feeds(spark, tmp_path):
    rnd = random.Random(7)
    events = []
    for i in range(400):
        spec = lambda: rnd.choice(["", None, "3", "1-4", "9-7, 2", "5 6,8-9", "x", "4--9", "1.5", " 2 , 3 "])
        at = f"2026-01-01T{rnd.randrange(3):02}:00:{rnd.randrange(4):02}Z"
        events.append((f"e{i:04}", rnd.choice("st"), at, i, rnd.choice(["ann", "bob", None]), rnd.choice(["assign", "Assign ", "UNASSIGN", "move", None]), spec(), spec()))
    sent = events + rnd.choices(events, k=300)
    rnd.shuffle(sent)
    assert run(spark, sent, str(tmp_path / "s")) == replay(events)


def test_edges(spark, tmp_path):
    at = "2026-01-01T00:00:00+09:00"
    events = [
        ("a", "s", at, 0, "ann", "assign", "1-3", None),
        ("b", "s", "2025-12-31T15:00:00Z", 1, "bob", "assign", "3", "1"),
        ("c", "s", None, 2, "eve", "assign", "1", None),
        ("d", "s", "no time", 2, "eve", "assign", "1", None),
        ("e", None, at, 3, "eve", "assign", "1", None),
        ("f", "s", at, 2, "eve", "assign", "1-999999", None),
        ("g", "s", at, None, "eve", "assign", "2", None),
    ]
    assert run(spark, events, str(tmp_path / "s")) == {("s", 2, "eve"), ("s", 3, "bob")}
    assert run(spark, [], str(tmp_path / "e")) == set()


def test_publish_is_whole(spark, tmp_path):
    folder = str(tmp_path / "p")
    one = changes.publish(spark.range(3).toDF("x"), folder)
    two = changes.publish(spark.range(5).toDF("x"), folder)
    assert changes.versions(spark, folder) == [1, 2] and one != two
    assert spark.read.parquet(two).count() == 5 and spark.read.parquet(one).count() == 3


def test_chunk_lists(spark):
    specs = ["9-0, 3,3", "0-2, 5", "", None, "a", "7", "1 2\t3", "99999999999999999999", "4-"]
    df = spark.createDataFrame([(s,) for s in specs], "s string")
    out = [(r.n, r.f) for r in df.select(chunks.parse_chunks(F.col("s")).alias("n"), chunks.format_chunks(chunks.parse_chunks(F.col("s"))).alias("f")).collect()]
    assert out == [(list(range(10)), "0-9"), ([0, 1, 2, 5], "0-2, 5"), (None, None), (None, None), (None, None), ([7], "7"), ([1, 2, 3], "1-3"), (None, None), (None, None)]


def test_assignment_conflicts(spark):
    from reelgrid.operators import labelstore

    state = spark.createDataFrame([("s", 1, "ann"), ("s", 2, "ann"), ("s", 3, "bob"), ("s", 4, "bob"), ("s", 6, "cleo"), ("t", 1, "bob")], "store_id string, chunk long, user_id string")
    requests = [
        (1, "s", "ann", "1-6", False), (2, "s", "ann", "1-6", True), (3, "s", "ann", "2, 1", None), (4, "s", "ann", "1, 7", False),
        (5, "s", None, "3-9", False), (6, "s", "", "8", False), (7, "s", "ann", "x", True), (8, "t", "ann", "2", False),
    ]
    df = spark.createDataFrame(requests, "request_id long, store_id string, user_id string, spec string, force boolean")
    assert sorted(tuple(r) for r in labelstore.assign_conflicts(state, df).collect()) == [(i, u, n, c) for i in (1, 2) for u, n, c in (("bob", 2, "3-4"), ("cleo", 1, "6"))]
    out = {r.request_id: (r.outcome, r.added, r.removed) for r in labelstore.assign_outcomes(state, df).collect()}
    assert out == {
        1: ("conflict", 0, 0), 2: ("changed", 4, 0), 3: ("unchanged", 0, 0), 4: ("changed", 1, 1),
        5: ("changed", 0, 3), 6: ("unchanged", 0, 0), 7: ("unreadable", 0, 0), 8: ("changed", 1, 0),
    }


def feed(seed, n):
    rnd = random.Random(seed)
    b = changes.BLOCK
    spec = lambda: rnd.choice(["", None, "3", "1-4", f"0-{2 * b}", f"{b}-{2 * b - 1}", f"{b - 2}-{b + 1}, {3 * b}", f"{2 * b + 5}-{b + 7}"])
    return [(f"e{i:04}", rnd.choice("st"), f"2026-01-01T0{rnd.randrange(3)}:00:00Z", i, rnd.choice(["ann", "bob", "", None]), rnd.choice(["assign", "assign", "unassign"]), spec(), spec()) for i in range(n)]


def test_blocks_and_halves(spark, tmp_path):
    events = feed(3, 60)
    frame = lambda es: changes.assignment_changes(spark.createDataFrame([(*e, "x", 1) for e in es], SCHEMA))
    random.Random(4).shuffle(events)
    want = replay(events)
    whole = str(tmp_path / "whole")
    assert run(spark, events, whole) == want
    halves = str(tmp_path / "halves")
    changes.apply_feed(frame(events[:30]), halves)
    state = changes.apply_feed(frame(events[25:]), halves)
    rows = state.where("v IS NOT NULL").selectExpr("k", "explode(sequence(lo, hi)) AS n", "v").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert changes.versions(spark, halves) == [1, 2]
    # a version is published once: a writer that began before another one finished starts again
    assert changes.publish(state, halves, 2) is None and changes.versions(spark, halves) == [1, 2]
    assert changes.published(spark, halves, 1).count() != changes.published(spark, halves).count()


def test_very_wide_ranges(spark, tmp_path):
    at = "2026-01-01T00:00:00Z"
    events = [("a", "s", at, 0, "ann", "assign", "0-1000000", None), ("b", "s", at, 1, "bob", "assign", "5", "999000-999999"), ("c", "t", at, 2, "eve", "assign", "0-40000000000", None)]
    df = spark.createDataFrame([(*e, "x", 1) for e in events], SCHEMA)
    out = changes.assigned_chunks(df.where("store_id = 's'"), str(tmp_path / "s"), widest=None)
    assert {r.user_id: (r.n, r.lo, r.hi) for r in out.groupBy("user_id").agg(F.count("*").alias("n"), F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).collect()} == {"ann": (999_000, 0, 1_000_000), "bob": (1, 5, 5)}
    ranges = changes.assigned_ranges(df, str(tmp_path / "r"))
    assert ranges.where("store_id = 't'").agg(F.sum(F.expr("hi - lo + 1"))).first()[0] == 40_000_000_001


def test_two_publishers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = str(tmp_path / "p")
    with ThreadPoolExecutor(4) as pool:
        paths = list(pool.map(lambda n: changes.publish(spark.range(n).toDF("x"), folder), range(1, 9)))
    assert changes.versions(spark, folder) == list(range(1, 9)) and len(set(paths)) == 8
    assert sorted(changes.published(spark, folder, v).count() for v in range(1, 9)) == list(range(1, 9))
    (tmp_path / "p" / "v000000000009").write_text("")  # a writer that was lost here
    assert changes.versions(spark, folder)[-1] == 8 and changes.published(spark, folder).count() == changes.published(spark, folder, 8).count()
    changes.publish(spark.range(3).toDF("x"), folder)
    assert changes.versions(spark, folder)[-1] == 10 and changes.published(spark, folder).count() == 3


def test_merged_ranges(spark):
    rnd = random.Random(5)
    lists = [", ".join(f"{a}-{a + rnd.randrange(9)}" if rnd.random() < 0.7 else str(a) for a in (rnd.randrange(120) for _ in range(rnd.randrange(1, 25)))) for _ in range(200)]
    lists += ["1 " * 50_000, "9223372036854775807, 0-3", "5-", "-5", "1--2", "9223372036854775808", "0-9223372036854775807,3"]
    df = spark.createDataFrame([(s,) for s in lists], "s string").select("s", chunks.merged(chunks.ranges(F.col("s"))).alias("m"))
    for s, m in df.collect():
        parts = [p for p in re.split(r"[,\s]+", s) if p]
        if s in ("5-", "-5", "1--2", "9223372036854775808"):
            assert m is None
        elif "9223" in s:
            assert [(r.lo, r.hi) for r in m][-1][1] == 2**63 - 1
        else:
            want = {n for p in parts for n in range(int(p.split("-")[0]), int(p.split("-")[-1]) + 1)}
            assert {n for r in m for n in range(r.lo, r.hi + 1)} == want and all(x.hi + 1 < y.lo for x, y in zip(m, m[1:]))
