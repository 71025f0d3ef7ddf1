"""Motion files, cameras, descriptions, lists and merged tables."""

import json
import math

from pyspark.sql import functions as F

from reelgrid.functions import model_text
from reelgrid.operators import merge, timeseries
from reelgrid.sources import files, motion


def test_times_and_tracks(spark, tmp_path):
    spark.createDataFrame([(10, 1), (20, 2)], "timestamp long, other long").coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(5,), (6,)], "when long").coalesce(1).write.parquet(str(tmp_path / "b"))
    (tmp_path / "t").mkdir()
    for part, name in (("a", "u1.front.timestamps.parquet"), ("b", "u2.front.timestamps.parquet")):
        next((tmp_path / part).glob("*.parquet")).rename(tmp_path / "t" / name)
    assert sorted(tuple(r) for r in motion.read_timestamps(spark, str(tmp_path / "t")).collect()) == [("u1", 0, 10), ("u1", 1, 20), ("u2", 0, 5), ("u2", 1, 6)]
    doc = {"clips": {"u": {"t_us": [0, 500_000], "vx": [3.0, 0.0], "vy": [4.0, 0.0], "ax": [1.0], "yaw_deg": [0.0, 5.0]}, "v": {"vx": [1.0]}}}
    (tmp_path / "tracks.json").write_text(json.dumps(doc))
    assert sorted(tuple(r) for r in motion.read_tracks(spark, str(tmp_path / "tracks.json")).collect()) == [("u", 0, 5.0, 1.0, 0.0), ("u", 500_000, 0.0, None, 5.0)]


def test_samples_and_cameras(spark, tmp_path):
    half = math.sqrt(0.5)
    raw = spark.createDataFrame([("u", 7, 3.0, 4.0, 0.5, 0.1, 0.0, 0.0, half, half, 1.0, 2.0, 3.0), ("u", None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], "uuid string, timestamp long, vx double, vy double, ax double, curvature double, qx double, qy double, qz double, qw double, x double, y double, z double")
    row = motion.motion_samples(raw).collect()
    assert len(row) == 1 and row[0].speed == 5 and round(row[0].yaw_deg, 6) == 90
    lens = json.dumps({"principal_point": [50.0, 40.0], "angle_to_pixeldist_poly": [0.0, 100.0], "max_angle": 1.2, "resolution": [100, 80]})
    spark.createDataFrame([("u", "front", lens), ("v", "front", "broken")], "uuid string, cam string, model_parameters string").write.parquet(str(tmp_path / "i"))
    spark.createDataFrame([("u", "front", 0.0, 0.0, 0.0, 2.0, 1.0, 0.0, 0.0), ("v", "front", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], "uuid string, cam string, qx double, qy double, qz double, qw double, x double, y double, z double").write.parquet(str(tmp_path / "e"))
    cams = motion.read_calibration(spark, str(tmp_path / "i"), str(tmp_path / "e"))
    c = F.col
    seen = timeseries.into_camera([F.lit(1.0), F.lit(0.0), F.lit(5.0)], [c("qx"), c("qy"), c("qz"), c("qw")], [c("x"), c("y"), c("z")])
    at = cams.select(timeseries.fisheye(*seen, c("poly"), c("cx"), c("cy"), c("max_angle")).alias("p"), "width").collect()
    assert len(at) == 1 and tuple(at[0].p) == (50.0, 40.0, True) and at[0].width == 100
    turned = spark.range(1).select(*timeseries.into_camera([F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(half), F.lit(half)], [F.lit(0.0)] * 3)).first()
    assert [round(v, 9) for v in turned] == [0, -1, 0]


def test_descriptions(spark):
    cols = "uuid string, span_s double, speed_start double, speed_end double, speed_min double, speed_max double, min_ax double, t_min_ax double, stopped_s double, heading_delta double"
    rows = [("a", 20.0, 30.0, 0.0, 0.0, 31.0, -3.5, 4.4, 3.0, -20.0), ("b", 20.0, 0.0, 36.5, 0.0, 36.5, -1.0, 0.0, 6.5, 0.0), ("c", 20.0, 50.0, 51.0, 49.0, 53.0, 0.0, 0.0, 0.0, 0.0), ("d", 20.0, 10.0, 30.0, 8.0, 30.0, 0.0, 0.0, 0.0, 15.0), ("e", 20.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 20.0, 0.0)]
    out = {r.uuid: r for r in timeseries.described(spark.createDataFrame(rows, cols)).collect()}
    assert out["a"].behaviour == "Over these 20 seconds the ego-vehicle slowed from 30 km/h and came to a stop, with a peak deceleration of 3.5 m/s^2 about 4 s in, and turned right by 20 degrees."
    assert out["b"].behaviour == "Over these 20 seconds the ego-vehicle pulled away from a stop to 36 km/h. It was stationary for about 6 s of that."
    assert out["c"].behaviour == "Over these 20 seconds the ego-vehicle held a steady 53 km/h." and out["c"].speed_range == "49-53"
    assert out["d"].behaviour.endswith("went from 10 to 30 km/h (range 8-30 km/h), and turned left by 15 degrees.") and (out["d"].motion, out["e"].motion) == ("moving", "stopped")


def test_reason_parts(spark):
    texts = ["A: one | B=2: two | more |  | B: three", "x | A: y", "", None, "A:"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    out = [[tuple(p) for p in r.p] for r in df.select(model_text.reason_parts(F.col("t"), ["A", "B"]).alias("p")).collect()]
    assert out == [[("A", "one B=2: two more"), ("B", "three")], [("A", "y"), (None, "x")], [], [], [("A", "")]]


def test_lists_and_configurations(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "uuid string, x int")
    wanted = spark.createDataFrame([("b", 5), ("b", 2), ("z", 1), (None, 0), ("c", 9)], "uuid string, pos int")
    assert sorted(tuple(r) for r in merge.allowed(rows, wanted).collect()) == [("b", 2, 2), ("b", 3, 2), ("c", 4, 9)]
    assert sorted((r.uuid, r.pos) for r in merge.in_dataset_order(rows, wanted).collect()) == [("a", 3), ("b", 2), ("b", 2), ("c", 9)]
    runs = spark.createDataFrame([("r1", {"m": "1", "n": "2"}, "d1", ["d2"]), ("r2", {"m": "1"}, "d1", None)], "run_id string, key map<string,string>, at string, resumes array<string>")
    starts = spark.createDataFrame([("r1", {"n": "2", "m": "1"}, "d3"), ("r2", {"m": "2"}, "d4"), ("r3", {"m": "9"}, "d5")], "run_id string, key map<string,string>, at string")
    out = {r.run_id: (r.key, r.at, r.resumes) for r in merge.upsert_config(runs, starts).collect()}
    assert out == {"r1": ({"m": "1", "n": "2"}, "d1", ["d2", "d3"]), "r2": ({"m": "1"}, "d1", []), "r3": ({"m": "9"}, "d5", [])}


def test_merged_table(spark, tmp_path):
    for k, text in enumerate(("uuid,n_frames,classes\nb,3,A\nc,0,\n", 'uuid,n_frames,classes\na,2,"x\n""y"""\nc,4,B\n')):
        (tmp_path / f"shard_{k}.csv").write_text(text)
    rows = files.read_results(spark, str(tmp_path / "shard_*.csv"), ["uuid", "n_frames", "classes"])
    best = merge.keep_best(rows, ["uuid"], F.col("n_frames").cast("int") > 0, [F.col("file"), F.col("pos")]).drop("file", "pos")
    for _ in range(2):
        out = files.write_merged(best, str(tmp_path / "none*"), str(tmp_path / "all"))
    files.write_merged(best, str(tmp_path / "shard_*.csv"), out)
    assert not list(tmp_path.glob("shard_*")) and not list(tmp_path.glob("all.*"))
    got = files.read_results(spark, f"{out}/*.csv", ["uuid", "n_frames", "classes"]).orderBy("pos").collect()
    assert [(r.uuid, r.n_frames, r.classes) for r in got] == [("a", "2", 'x\n"y"'), ("b", "3", "A"), ("c", "4", "B")]
    index = spark.createDataFrame([("f", "b", "p"), ("f", "a", "p"), ("g", "a", "q")], "view string, uuid string, path string")
    assert files.lookup(index, ["a"], "g").collect()[0].path == "q" and files.lookup(index, ["a"]).count() == 2
    assert [r.uuid for r in files.keys_of(index, "f").collect()] == ["a", "b"]


def test_tokens_keys_and_timelines(spark):
    from reelgrid.operators import spans, tensors

    tokens = spark.createDataFrame([("d", i, t) for i, t in enumerate(["The ", "dog", " ran", "."])] + [("e", 0, "x")], "doc string, pos int, text string")
    regions = spark.createDataFrame([("d", "noun", 4, 7), ("d", "end", 9, 12), ("d", "none", 3, 3), ("e", "all", 0, 9)], "doc string, name string, start int, end int")
    assert sorted(tuple(r) for r in tensors.token_regions(tokens, regions).collect()) == [("d", "end", 2), ("d", "end", 3), ("d", "noun", 1), ("e", "all", 0)]
    texts = ['{"a": 1, "b.c" : "x"}', "none", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r.k for r in df.select(model_text.key_offsets(F.col("t"), ["a", "b.c"]).alias("k")).collect()] == [{"a": 6, "b.c": 17}, {}, {}]
    ends = spark.createDataFrame([("u", 3.0), ("u", 9.5), ("v", 1.0)], "uuid string, e double")
    assert {r.uuid: r.until for r in spans.timeline_ends(ends, ["uuid"], 4.0).collect()} == {"u": 9.5, "v": 4.0}


def test_progress_of_logs(spark, tmp_path):
    from reelgrid.operators import lineage

    (tmp_path / "a.log").write_text("start\n10/200 done\r20/200 done\nlast words\n\n")
    (tmp_path / "b.log").write_text("nothing\n")
    lines = files.read_lines(spark, str(tmp_path / "*.log"))
    assert {r.file: (r.done, r.total, r.tail) for r in lineage.log_progress(lines).collect()} == {"a.log": (20, 200, "last words"), "b.log": (None, None, "nothing")}


def test_kept_tensors_and_complete_scenes(spark, tmp_path):
    from reelgrid.operators import tensors

    vectors = spark.createDataFrame([(1, [1.0, -2.0, 3.0, 4.0]), (2, [0.0, 1.0, 1.0, 0.0])], "vec_id int, embedding array<float>")
    cells = tensors.long_form(vectors, 2)
    tensors.write_cells(cells, str(tmp_path / "cells"))
    rows = lambda df: sorted(tuple(r) for r in df.select("tok", "layer", "bucket", "v").collect())
    assert rows(tensors.read_cells(spark, str(tmp_path / "cells"))) == rows(cells)
    one = tensors.read_cells(spark, str(tmp_path / "cells"), [1])
    assert rows(one) == rows(cells.where("layer = 1")) and "PartitionFilters: [isnotnull(layer" in one._jdf.queryExecution().toString()
    frames = spark.createDataFrame([("s", True)] * 3 + [("t", True), ("t", None), ("t", True)] + [("u", True)], "scene string, ok boolean")
    assert [tuple(r) for r in merge.complete(frames, ["scene"], F.col("ok"), 3).collect()] == [("s", 3)]
    labels = spark.createDataFrame([("a", {"g": 7, "h": 0}, None)], "uuid string, group_scores map<string,int>, class_scores map<string,int>")
    assert files.within_scale(labels).first().group_scores == {"h": 0}
