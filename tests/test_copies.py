"""Differences between copies on small tables."""

from pyspark.sql import functions as F

from reelgrid.operators import copies

SCHEMA = "uuid string, rev int, group_scores map<string,int>, note string, kind string, bucket int"
D, E = "Dynamic object", "Driving environment"


def row(uuid, rev=1, d=0, e=0, note=""):
    return (uuid, rev, {D: d, E: e}, note, "clash", 7)


def diff(spark, store, mirror, buckets=16):
    a, b = spark.createDataFrame(store, SCHEMA), spark.createDataFrame(mirror, SCHEMA)
    out = [tuple(r) for r in copies.label_differences(a, b, buckets).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_cases(spark):
    store = [row("A "), row("a", 2, 3), row("b", d=None), row("c", note=None), row("d", note=" x\r\ny "), row("e", e=0), row("f"), row("f"), row("gone"), row(None)]
    mirror = [row("a", 2, 3), row("a", 1, 9), row("B", d=-1), row("c", note="  "), row("d", note="x\ny"), row("e", e=-1), row("f", note="x y"), row("new", 5)]
    mirror.append(("h", 1, None, None, None, None))
    store.append(("h", 1, {D: -1}, "", "", 0))
    assert diff(spark, store, mirror) == {("e", "differs", E), ("f", "differs", "note"), ("gone", "only_store", ""), ("new", "only_mirror", ""), (None, "only_store", "")}


def test_empty_and_equal(spark):
    rows = [row(f"u{i}", note="n" * (i * 1000)) for i in range(50)]
    assert diff(spark, [], []) == set()
    assert diff(spark, rows, rows + rows) == set()
    assert diff(spark, rows[:1], []) == {("u0", "only_store", "")}


def test_one_bucket_or_many(spark):
    store = [row(f"u{i % 40}", i // 40, i % 3, i % 2) for i in range(400)]
    mirror = [row(f"u{i % 37}", i // 37, i % 3, (i * 7) % 2) for i in range(370)]
    assert diff(spark, store, mirror, 1) == diff(spark, store, mirror, 4096)


def test_matrix_is_additive(spark):
    df = spark.createDataFrame([row(f"u{i}", d=i % 4) for i in range(100)], SCHEMA)
    spec = copies.label_copy(df)
    m = lambda x: {r.bucket: r for r in copies.checksum_matrix(x, copies.label_copy(x), 8).collect()}
    whole, even, odd = m(df), m(df.where(F.col("rev") == 1).where(F.hash("uuid") % 2 == 0)), m(df.where(F.hash("uuid") % 2 != 0))
    assert len(spec.fields) == 3
    for b, r in whole.items():
        parts = [x[b] for x in (even, odd) if b in x]
        assert r.n == sum(p.n for p in parts) and r.k == [sum(p.k[j] for p in parts) for j in range(4)]


def test_null_and_nul_differ(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 1, "\0"), ("c", 1, ""), ("d", 1, None)], "k string, v int, x string")
    other = spark.createDataFrame([("a", 1, "\0"), ("b", 1, None), ("c", 1, None), ("d", 1, None)], "k string, v int, x string")
    spec = lambda t: copies.CopySpec(t["k"], t["v"], {"x": t["x"]})
    for buckets in (1, 4096):
        out = copies.differences(df, other, spec(df), spec(other), left_name="l", right_name="r", buckets=buckets)
        assert sorted(tuple(r) for r in out.collect()) == [(k, "differs", "x") for k in "abc"]


def test_versions_of_other_types_and_ties(spark):
    rows = [("a", "2026-01-01 00:00:00", "x", "p"), ("a", "2026-01-02 00:00:00", "y", "q"), ("a", "2026-01-02 00:00:00", "z", "p"), ("b", None, "x", "p")]
    df = spark.createDataFrame(rows, "k string, t string, x string, y string").withColumn("t", F.col("t").cast("timestamp"))
    back = spark.createDataFrame(rows[::-1], "k string, t string, x string, y string").withColumn("t", F.col("t").cast("timestamp"))
    spec = lambda t: copies.CopySpec(t["k"], t["t"], {"x": t["x"], "y": t["y"]})
    assert copies.differences(df, back, spec(df), spec(back), left_name="l", right_name="r").collect() == []
    one = df.where("x <> 'z'")
    out = {tuple(r) for r in copies.differences(one, back, spec(one), spec(back), left_name="l", right_name="r").collect()}
    assert out <= {("a", "differs", "x"), ("a", "differs", "y")} and out


def test_many_unequal_buckets(spark, monkeypatch):
    store = [row(f"u{i}", d=i % 3) for i in range(300)]
    mirror = [row(f"u{i}", d=0) for i in range(300)]
    want = diff(spark, store, mirror, 4096)
    monkeypatch.setattr(copies, "SMALL", 3)
    assert diff(spark, store, mirror, 4096) == want == {(f"u{i}", "differs", D) for i in range(300) if i % 3}
    assert copies.bucket_count(spark.range(10)) == copies.BUCKETS and copies.bucket_count(spark.range(100_000_000)) == 1 << 19
