"""Second questions and scores by field, on rows that have some."""

from pyspark.sql import functions as F

from reelgrid.functions import packed
from reelgrid.operators import evaluate as ev
from reelgrid.operators import recheck

BEST = "run_id string, uuid string, n_frames int, parse_ok int, verdict string, n_classes int, classes string, observation string, ego_behavior string, unusual_elements string, group_scores string, field_scores string, score_reason string, tier_score int"
ANSWERS = "answer_id long, run_id string, shard_no int, answered_at timestamp, uuid string, class_name string, group_name string, present boolean, score int, reason string"


def taxonomy(spark):
    rows = [("Walker", "Mover", 0, 0, False, ["walker", "on foot"]), ("Gravel", "Road", 1, 0, False, ["gravel|dirt"]), ("Odd road", "Road", 1, 1, True, []), ("Works", "Road", 1, 2, False, None)]
    return spark.createDataFrame(rows, "class_name string, group_name string, group_pos int, class_pos int, is_unknown boolean, recheck_keywords array<string>")


def row(uuid, classes="", observation=None, n_frames=8, parse_ok=1, groups="", fields="", reason=None):
    return ("r", uuid, n_frames, parse_ok, "Normal", 0, classes, observation, None, None, groups, fields, reason, None)


def test_candidates_and_open(spark):
    best = spark.createDataFrame([row("a", observation="A WALKER on gravel"), row("b", classes="Works", observation="walker"), row("c", observation="dirt", n_frames=0), row("d", observation="dirt road", parse_ok=0), row("e", observation="quiet"), row("f", observation="a person ON FOOT")], BEST)
    asked = {tuple(r) for r in recheck.candidates(best, taxonomy(spark)).collect()}
    assert asked == {("r", "a", "Walker"), ("r", "a", "Gravel"), ("r", "f", "Walker")}
    answers = spark.createDataFrame([(1, "r", 0, None, "a", "Walker", "Mover", False, 0, None)], ANSWERS)
    assert {tuple(r) for r in recheck.open_questions(best, taxonomy(spark), answers).collect()} == asked - {("r", "a", "Walker")}
    assert recheck.candidates(best.limit(0), taxonomy(spark)).count() == 0


def test_answers_raise_scores_in_order(spark):
    best = spark.createDataFrame([row("a", "Works", groups="Road=1|Mover=0", fields="Works=1|Road=0", reason="w"), row("b", groups="Mover=3"), row("c", "Works")], BEST)
    rows = [
        (1, "r", 0, None, "a", "Gravel", "Road", True, 3, "dust"), (2, "r", 0, None, "a", "Walker", "Mover", True, 2, None), (3, "r", 1, None, "b", "Walker", "Mover", True, 2, "x"),
        (4, "r", 0, None, "b", "Gravel", "Road", True, 1, "low"), (5, "r", 0, None, "c", "Walker", "Mover", True, 4, ""), (6, "r", 2, None, "c", "Walker", "Mover", False, 0, ""),
    ]
    answers = spark.createDataFrame(rows, ANSWERS)
    out = {r.uuid: r for r in recheck.apply_answers(best, answers, own=("Gravel",)).collect()}
    a, b, c = out["a"], out["b"], out["c"]
    assert (a.classes, a.n_classes, a.verdict, a.group_scores, a.field_scores, a.tier_score, a.score_reason) == ("Works|Gravel|Walker", 3, "Special", "Road=3|Mover=2", "Works=1|Road=0|Gravel=3|Mover=2", 3, "w | recheck Gravel: dust | recheck Walker: ")
    assert (b.classes, b.group_scores, b.field_scores, b.tier_score) == ("Walker", "Mover=3", "Mover=2", 3)
    assert (c.classes, c.verdict, c.group_scores) == ("Works", "Normal", "")
    plain = {r.uuid: r for r in recheck.apply_answers(best.drop("field_scores"), answers, with_scores=False).collect()}
    assert (plain["b"].classes, plain["b"].group_scores, plain["b"].tier_score) == ("Walker|Gravel", "Mover=3", None) and "field_scores" not in plain["b"]


def test_missing_clips(spark):
    labels = spark.createDataFrame([("A ", ["x"]), ("b", []), ("c", None), ("d", ["x"])], "uuid string, class_list array<string>")
    results = spark.createDataFrame([(" a",), ("B",), (None,)], "uuid string")
    assert [r.uuid for r in ev.missing_clips(results, labels).collect()] == ["d"]


def test_folded_and_split_scores(spark):
    tax = ev.Taxonomy.of(taxonomy(spark))
    df = spark.createDataFrame([({"Gravel": 3, "Road": 1, "?": 4}, ["Works"]), ({"Gravel": 3, "Walker": 2}, ["Gravel"]), ({}, [])], "f map<string,int>, c array<string>")
    assert [r.x for r in df.select(ev.folded_scores(F.col("f"), F.col("c"), tax, ["Gravel"]).alias("x")).collect()] == [{"Road": 1}, {"Mover": 2, "Road": 3}, {}]
    schema = "run_id string, uuid string, gt array<string>, pred array<string>, gt_scores map<string,int>, pred_scores map<string,int>, class_scores map<string,int>, pred_fields map<string,int>, pred_reason string"
    rows = [
        ("fields", ["Works", "Gravel"], ["Works"], {"Road": 3}, {"Road": 2}, {"Works": 1, "Gravel": 3}, {"Road": 2}, None),
        ("reason", ["Works"], ["Works"], {"Road": 1}, {"Road": 3}, {"Works": 1}, None, "Works | Gravel=2: dust"),
        ("level", ["Works"], ["Works"], {"Road": 1}, {"Road": 2}, {"Works": 1}, None, "Gravel=2: dust"),
        ("asked", ["Works"], ["Works"], {"Road": 1}, {"Road": 2}, {"Works": 1}, None, "recheck Works: seen"),
        ("zero", ["Works"], [], {"Road": 1}, {"Road": 0}, {"Works": 1}, None, None),
        ("none", ["Works"], [], {"Road": 1}, {"Mover": 0}, {"Works": 1}, None, None),
        ("unrated", ["Works"], ["Works"], {"Road": 1}, {"Road": 2}, None, {"Road": 2}, None),
    ]
    got = {(r.uuid, r.name): (r.t, r.p) for r in ev.split_scores(spark.createDataFrame([("r", *x) for x in rows], schema), tax, ["Gravel"]).collect()}
    others = "Road: Others"
    assert got == {
        ("fields", others): (1, 2), ("fields", "Gravel"): (3, 0), ("reason", others): (1, 3), ("reason", "Gravel"): (0, 2),
        ("level", "Gravel"): (0, 2), ("zero", others): (1, 0), ("zero", "Gravel"): (0, 0),
    }


def test_scale_in_words(spark):
    rows = [[0, 1, 2, 3, 4], [3, 0, 1], [2], [], [1, 3], [4, 2, 2, 0]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<int>").orderBy("i")
    assert [r.t for r in df.select(packed.values_text(F.col("v")).alias("t")).collect()] == ["0-4", "0, 1 or 3", "2-2", "", "1 or 3", "0, 2 or 4"]
