"""Changes of labels and classes, on the cases the docstrings name."""

from pyspark.sql import functions as F

from reelgrid.operators import labelstore as ls
from reelgrid.operators.evaluate import Taxonomy

TAX = "section string, group_name string, group_pos int, class_name string, class_pos int, is_unknown boolean, templates array<string>, recheck_keywords array<string>"


def test_patches(spark):
    current = spark.createDataFrame([("a", "x", True, 1), ("b", "y", None, 2), ("c", "z", False, 3)], "uuid string, note string, is_night boolean, rev int")
    patches = [
        ("a", 1, False, ["note"], "n1", None), ("a", 2, None, ["is_night"], "ignored", None), ("b", 1, True, None, None, None), ("b", 2, False, ["note"], "new", None),
        ("c", 1, False, ["note"], "w", None), ("c", 2, True, [], None, None), ("d", 1, False, ["is_night", "?"], None, True), ("e", 1, True, None, None, None),
    ]
    df = spark.createDataFrame(patches, "uuid string, seq int, is_delete boolean, fields array<string>, note string, is_night boolean")
    out = {tuple(r) for r in ls.patch_labels(current, df).collect()}
    assert out == {("a", "n1", None, 1), ("b", "new", None, None), ("d", None, True, None)}
    assert {tuple(r) for r in ls.patch_labels(current, df.limit(0)).collect()} == {tuple(r) for r in current.collect()}


def test_classes_are_rewritten(spark):
    rows = [("s", "Mover", 0, "Walker", 0, False, ["a"], ["k"]), ("s", "Mover", 0, "Dog", 1, False, ["b"], None), ("s", "Road", 1, "Works", 0, False, ["c"], ["w"])]
    edits = [("Walker", "Person", None, None, None), ("Dog", None, "Road", ["d"], None), ("Works", None, None, None, True), (None, "Kite", "Air", [], False), (None, "Cat", "Mover", None, False), ("gone", "x", None, None, None)]
    df = ls.rewrite_classes(spark.createDataFrame(rows, TAX), spark.createDataFrame(edits, "old_name string, class_name string, group_name string, templates array<string>, is_delete boolean"))
    out = sorted((r.group_name, r.group_pos, r.class_name, r.class_pos, r.templates, r.recheck_keywords) for r in df.collect())
    assert out == [("Air", 2, "Kite", 0, [], None), ("Mover", 0, "Cat", 2, None, None), ("Mover", 0, "Person", 0, ["a"], ["k"]), ("Road", 1, "Dog", 1, ["d"], None)]


def test_errors(spark):
    schema = "uuid string, classes map<string,int>, group_scores map<string,int>, weather map<string,int>, rain_snow_fog array<string>, note string"
    tax = Taxonomy({"Walker": "Mover"}, frozenset())
    was = spark.createDataFrame([("old", {"Gone": 3, "Walker": 0}, {"Mover": 9}, None, None, None)], schema)
    rows = [("ok", {"Walker": 4}, {"Mover": 2}, {"fogginess": 0}, ["fog"], "x"), ("old", {"Gone": 3, "Walker": 0}, {"Mover": 9}, None, None, None), ("bad", {"New": 2, "Walker": 0}, {"Mover": 4}, {"dark": -1}, ["hail", "rain"], "y" * 11), ("none", None, None, None, None, None)]
    out = {r.uuid: r.errors for r in ls.label_errors(spark.createDataFrame(rows, schema), was, tax, of_group={"Mover": [0, 1, 2]}, longest_note=10).collect()}
    assert out == {"bad": ["unknown class New", "classes.Walker = 0", "group_scores.Mover = 4", "weather.dark = -1", "unknown tag hail", "note of 11 characters"]}


def test_free_and_dealt_ranges(spark):
    taken = spark.createDataFrame([("s", 0, 2, "a"), ("s", 5, 5, "b"), ("s", 6, 9, "a"), ("s", 2_000_000_000, 2_000_000_000, "a"), ("t", 3, 4, "c")], "store_id string, lo long, hi long, user_id string")
    free = ls.free_ranges(taken)
    assert sorted(tuple(r) for r in free.collect()) == [("s", 3, 4), ("s", 10, 1_999_999_999), ("t", 0, 2)]
    dealt = {(r.store_id, r.chunk): r.user_id for r in ls.auto_assign(free, ["x", "y", "x"], 2).collect()}
    assert dealt == {("s", 3): "x", ("s", 4): "x", ("s", 10): "y", ("s", 11): "y", ("t", 0): "x", ("t", 1): "x", ("t", 2): "y"}
    assert {(r.store_id, r.user_id): (r.n_chunks, r.chunks) for r in ls.assignment_summary(taken).collect()}["s", "a"] == (8, "0-2, 6-9, 2000000000")


def test_last_events(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("t"))
    assert [r.t for r in ls.last_events(df, [F.desc("t")], 3).collect()] == [99, 98, 97]
