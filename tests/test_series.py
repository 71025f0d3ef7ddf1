"""Time series and clip lists against plain implementations, and in proportion to their length."""

import random
import time

from pyspark.sql import functions as F

from reelgrid.operators import labelstore, timeseries


def test_asof_both_ways(spark):
    rnd = random.Random(1)
    left = [("u", rnd.randrange(100), i) for i in range(80)] + [("v", 5, 80)]
    right = [("u", rnd.randrange(100), float(rnd.randrange(9))) for _ in range(60)]
    a, b = spark.createDataFrame(left, "uuid string, t_us long, id int"), spark.createDataFrame(right, "uuid string, t_us long, speed double")
    for forward in (False, True):
        got = {r.id: (r.speed, r.at_us) for r in timeseries.asof(a, b, ["speed"], forward).collect()}
        want = {}
        for u, t, i in left:
            near = [(x, v) for w, x, v in right if w == u and (x >= t if forward else x <= t)]
            x, v = (min(near) if forward else max(near)) if near else (None, None)
            want[i] = (v, x)
        assert got == want


def test_windows(spark):
    rnd = random.Random(2)
    samples = [("u", rnd.randrange(60) * 500_000, rnd.choice([None, 1.0, 2.0, 5.0])) for _ in range(90)]
    windows = [("u", b * 500_000, (b + rnd.randrange(0, 30)) * 500_000) for b in (rnd.randrange(-20, 80) for _ in range(60))]
    first, last = min(t for _, t, _ in samples), max(t for _, t, _ in samples)
    want = set()
    for u, b, e in set(windows):
        lo, hi = max(b, first), min(e, last)
        inside = [v for _, t, v in samples if lo <= t <= hi]
        known = [v for v in inside if v is not None]
        if hi - lo >= 1_000_000 and len(inside) >= 2:
            want.add((u, b, e, lo, hi, len(inside) * windows.count((u, b, e)), round(sum(known) / len(known), 6) if known else None))
    a, b = spark.createDataFrame(samples, "uuid string, t_us long, speed double"), spark.createDataFrame(windows, "uuid string, beg long, end long")
    got = [tuple(r) for r in timeseries.within_windows(a, b).withColumn("speed", F.round("speed", 6)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_next_open(spark):
    rnd = random.Random(3)
    clips = [(rnd.choice("abc"), f"{i:04}", rnd.random() < 0.1) for i in range(500)] + [("d", "0", True), ("e", "0", False)]
    want = {}
    for g in "abcde":
        ids = sorted((u, o) for h, u, o in clips if h == g)
        opened = [u for u, o in ids if o]
        for u, _ in ids:
            n = next((x for x in opened if x > u), opened[0] if opened else None)
            want[g, u] = None if n == u else n
    got = {(r.group, r.uuid): r.next_uuid for r in labelstore.next_open(spark.createDataFrame(clips, "group string, uuid string, open boolean")).collect()}
    assert got == want


def test_one_long_series(spark):
    """Ten times the rows of one key take about ten times as long at most."""

    def run(n):
        rows = spark.range(n).select(F.lit("u").alias("uuid"), F.lit("g").alias("group"), F.col("id").alias("t_us"), F.col("id").cast("int").alias("id"), F.lit(1.0).alias("speed"), (F.col("id") == n - 1).alias("open")).cache()
        rows.count()
        began = time.time()
        timeseries.asof(rows, rows.where("t_us % 7 = 0"), ["speed"], forward=True).write.format("noop").mode("overwrite").save()
        labelstore.next_open(rows.withColumn("uuid", F.format_string("%09d", "id"))).write.format("noop").mode("overwrite").save()
        timeseries.within_windows(rows.withColumn("t_us", F.col("t_us") * 1000), rows.select("uuid", (F.col("t_us") * 1000).alias("beg"), (F.col("t_us") * 1000 + 5_000_000).alias("end"))).write.format("noop").mode("overwrite").save()
        return time.time() - began

    run(2_000)
    small, large = run(20_000), run(200_000)
    assert large < 15 * max(small, 0.5)
