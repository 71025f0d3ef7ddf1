"""Truncated answers: whole texts cut at known places must be found, whole ones not."""

import random
import re

from reelgrid.llm import truncation

SCHEMA = "answer_id long, run_id string, raw string"


def run(spark, texts):
    rows = [(i, "r", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", id string, open int")
    found = [r.answer_id for r in truncation.truncated(df).collect()]
    assert len(found) == len(set(found))
    return set(found)


def whole(spark):
    """Whole answers of the test tables: JSON or prose that ends as a sentence does."""
    df = spark.read.parquet("/root/testdata/sf0.1/recheck_answers.parquet").where("raw IS NOT NULL").select("raw").collect()
    ends = re.compile(r'"(?:present|score)": (?:true|false|[0-4])\s*\}(?:\n```|</answer>)?$')
    good = [r.raw for r in df if ends.search(r.raw) or re.fullmatch(r'[^{}"]+\.', r.raw) or r.raw in ("no", "yes", "No", "Yes")]
    return random.Random(5).sample(good, 2_000)


def test_cuts_are_found(spark):
    texts = whole(spark)
    cut, rnd = set(), random.Random(6)
    for i in range(0, len(texts), 5):
        t = texts[i]
        if "}" not in t:
            continue
        at = rnd.randrange(t.index("{") + 2, t.rindex("}"))
        texts[i] = t[:at] + rnd.choice(["", "", "…", " […]", "...", "\n```"])
        cut.add(i)
    found = run(spark, texts)
    assert len(found & cut) >= 0.97 * len(cut)
    assert len(found - cut) <= 0.02 * len(texts)


def test_edges(spark):
    good = ['{"present": false, "score": 0}', "The road is clear and dry.", "no"] * 20
    odd = [None, "", "  \n", '{"present": false, "score" = 0}', '{"present": false, "score": 0,}', '{"a": {"b": "}"}, "score": 0}']
    lost = ['{"present": fal', '{"present": false, "score"', "The road is cle", '{"present": false, "score": 0} The road is', "x " * 200_000 + '{"present": "' + "y" * 100_000]
    found = run(spark, good + odd + lost)
    at = len(good) + len(odd)
    assert not found & set(range(at))
    assert {at, at + 1, at + 2, at + 3} <= found
    assert run(spark, []) == set()


def test_rates(spark):
    rows = [(i, None if i % 2 else "a", '{"score": 0}' if i < 40 else '{"score"') for i in range(42)]
    out = {r.run_id: (r.n, r.n_truncated, r.share) for r in truncation.truncation_rates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {"a": (21, 1, 1 / 21), None: (21, 1, 1 / 21)}


def test_copies_of_a_cut_answer_are_found(spark):
    good = ['{"present": false, "score": 0, "reason": "The road is clear."}', "The road is clear and dry.", "no"] * 10
    at_one_place = [f'{{"reason": "Lane {w} is closed off", "zebra" ' for w in ("one", "two", "left", "right")]
    prose = '{"present": false, "score": 0} Nothing else can be seen near the long wall, and after that bend the'
    lost = ['{"present": false, "quokka'] * 6 + at_one_place * 2 + [prose] * 6
    odd = ['{"reason": "a 5" pole", "present": false}', '{"LANE 19" hangs over the road, which is clear and dry.'] * 8
    found = run(spark, good + odd + lost)
    at = len(good) + len(odd)
    assert found == set(range(at, at + len(lost)))


def test_very_many_blanks_and_marks(spark):
    good = ["The road is clear and dry.", '{"present": false, "score": 0}'] * 10
    filler = ["\n" * 20_000, " \t" * 300_000, "<b>" * 50_000, "`" * 50_000, "..." * 50_000]
    whole = [f"The road is clear{x} and dry." for x in filler] + [f'{{"present": false, "score": 0}}{x}' for x in filler[:4]]
    lost = [f'{{"present": fal{x}' for x in filler[:4]] + [f'{{"score"{x}: 0, "present": fa' for x in filler[:2]]
    found = run(spark, good + whole + lost)
    at = len(good) + len(whole)
    assert not found & set(range(at)) and set(range(at, at + len(lost))) <= found
