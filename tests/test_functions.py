"""Scalar functions on the cases that bite."""

from pyspark.sql import functions as F

from reelgrid.functions import answers, packed
from reelgrid.operators import evaluate as ev


def values(spark, kind, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_packed(spark):
    cells = ["a=1|b=2", "a=1|a=3", "x=y=2|b=n/a|=4|c", None, "", " k = 5 ", "a=2.0", "a=b\nc=3"]
    assert values(spark, "string", cells, packed.parse_packed) == [{"a": 1, "b": 2}, {"a": 3}, {"x=y": 2}, {}, {}, {"k": 5}, {}, {"a=b\nc": 3}]
    assert values(spark, "string", ["A| B |", " ", None], packed.split_classes) == [["A", "B"], [], []]
    assert values(spark, "string", ["A| B |", " ", None], lambda c: packed.split_classes(c, trim=False)) == [["A", " B ", ""], [], []]
    assert values(spark, "map<string,int>", [{"b": 1, "a": 2}, {}], packed.pack) == ["a=2|b=1", ""]


def test_numbers(spark):
    texts = ["2", "2.0", "2.9", "x", None, " 3 ", "-1"]
    assert values(spark, "string", texts, packed.int_strict) == [2, None, None, None, None, 3, -1]
    assert values(spark, "string", texts, packed.int_loose) == [2, 2, 2, None, None, 3, -1]
    assert values(spark, "string", ["2.5", "3.5", "2 (moderate)", "5", "2/4", "x", None], packed.leading_score) == [2, 4, 2, None, 2, None, None]
    assert values(spark, "string", ["Dynamic object", "  A--b! ", "", None], packed.slug) == ["dynamic_object", "a_b", "", None]


def test_tier_words(spark):
    texts = ["High risk", "low to moderate", "low-risk", "low or high", "Medium", "rather high", "common, low rarity", "", None, "none"]
    assert values(spark, "string", texts, answers.tier_label) == ["High", "Moderate", "Low", "High", "Moderate", "High", "Low", "Unknown", "Unknown", "Unknown"]


def test_answers(spark):
    raw = ['{"present": "Yes", "score": "9"}', '{"present": true}', '{"present": true, "score": 2.9, "reason": " r "}', '{"present": false, "score": 3}', 'x {"present": 1} y', '{"present": true} {x}', '{"present": true,}', None, "", "[1]", '{"present": [], "score": 1}']
    got = [tuple(a) for a in values(spark, "string", raw, answers.parse_answer)]
    assert got == [(True, 4, "", True), (True, 1, "", True), (True, 2, "r", True), (False, 0, "", True), (True, 1, "", True), (False, 0, "", False), (False, 0, "", False), (False, 0, "", False), (False, 0, "", False), (False, 0, "", False), (False, 0, "", True)]


def test_empty_sets_score_one(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a"], ["a", "b"])], "g array<string>, p array<string>")
    out = [round(r.f, 6) for r in df.select(ev.set_f1(F.col("g"), F.col("p")).alias("f")).collect()]
    assert out == [1.0, 0.0, round(2 / 3, 6)]
