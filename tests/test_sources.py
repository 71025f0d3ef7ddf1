"""Files in and out, on small fixtures."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from reelgrid.operators import lineage
from reelgrid.sources import files


def test_results(spark, tmp_path):
    (tmp_path / "clip_results_b.csv").write_text('uuid,n_frames,categories,extra\nu1,0,,x\nu2,3,"A|B\nC ""q""",y\n')
    (tmp_path / "clip_results_a.csv").write_text("uuid,n_frames,classes\nu1,5,A\n")
    rows = files.read_results(spark, str(tmp_path / "clip_results*.csv"))
    got = {(r.file, r.uuid): (r.n_frames, r.classes, r.note if "note" in r else None) for r in rows.collect()}
    assert got[("clip_results_b.csv", "u2")][1] == 'A|B\nC "q"'
    assert got[("clip_results_a.csv", "u1")][:2] == ("5", "A")
    assert rows.columns == [*files.RESULT_COLUMNS, "file", "pos"]
    assert {r.file: r.n for r in files.file_counts(rows).collect()} == {"clip_results_a.csv": 1, "clip_results_b.csv": 2}


def test_labels_and_taxonomy(spark, tmp_path):
    doc = {"_meta": {}, "clips": {"u1": {"classes": ["A"], "Dynamic object": 2, "note": "n"}, "u2": {"categories": {"B": 3}, "Dynamic object": -1, "weather": {"illumination": 1}}, "u3": {"note": "x"}, "u4": 5}}
    (tmp_path / "l.json").write_text(json.dumps(doc))
    got = {r.uuid: r for r in files.read_label_documents(spark, str(tmp_path / "l.json")).collect()}
    assert set(got) == {"u1", "u2", "u3"}
    assert got["u1"].class_list == ["A"] and got["u1"].class_scores is None and got["u1"].group_scores == {"Dynamic object": 2}
    assert got["u2"].class_scores == {"B": 3} and got["u2"].group_scores == {} and got["u2"].weather == {"illumination": 1}
    assert got["u3"].missing
    tax = {"normal": {"scenarios": []}, "special": {"scenarios": [{"name": "G", "classes": [{"name": "A", "templates": ["t"]}, {"name": "U", "unknown": True}]}]}}
    (tmp_path / "t.json").write_text(json.dumps(tax))
    rows = files.read_taxonomy(spark, str(tmp_path / "t.json")).orderBy("class_pos").collect()
    assert [(r.section, r.group_name, r.class_name, r.is_unknown, r.templates) for r in rows] == [("special", "G", "A", False, ["t"]), ("special", "G", "U", True, [])]
    assert files.has_templates(spark, str(tmp_path / "t.json"))


def test_logs(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"seq": 1, "uuid": "a"}\n\n{"seq": 2, "uuid": "b"}\n{"seq": 3, "uu')
    assert sorted((r.seq, r.uuid) for r in files.read_log(spark, str(tmp_path / "h.jsonl"), "seq int, uuid string").collect()) == [(1, "a"), (2, "b")]
    (tmp_path / "ids.txt").write_text(" a \n\nb\n")
    assert [r.uuid for r in files.read_list(spark, str(tmp_path / "ids.txt")).orderBy("pos").collect()] == ["a", "b"]
    (tmp_path / "s0.log").write_text("10%\r20%\nTraceback (most recent call last)\n  File x\nKeyError: 'k'\n")
    (tmp_path / "s1.log").write_text("fine\n")
    (tmp_path / "s2.log").write_text("[error] one\n[error] two\nend\n")
    lines = files.read_lines(spark, str(tmp_path / "s*.log"))
    assert {r.file: r.detail for r in lineage.log_errors(lines).collect()} == {"s0.log": "KeyError: 'k'", "s2.log": "[error] two"}


def test_zip_index(spark, tmp_path):
    for no in (2, 10):
        (tmp_path / "front").mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / f"front/chunk_{no}.zip", "w") as z:
            z.writestr("u1.front.mp4", str(no))
            z.writestr(f"only{no}.mp4", "x")
            z.writestr("notes.txt", "x")
    (tmp_path / "front/chunk_99.zip").write_bytes(b"half a zip")
    got = {r.uuid: r for r in files.zip_index(spark, str(tmp_path)).collect()}
    assert set(got) == {"u1", "only2", "only10"}
    assert got["u1"].path.endswith("chunk_10.zip") and files.member_bytes(got["u1"].path, got["u1"].member) == b"10"


def test_writing(spark, tmp_path):
    df = spark.createDataFrame([("u", 1)], "uuid string, n int")
    files.append_results(df, str(tmp_path / "r"))
    files.append_results(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    with pytest.raises(ValueError, match="only now"):
        files.append_results(df.withColumn("x", F.lit(1)), str(tmp_path / "r"))
    lists = spark.createDataFrame([("A/B", "TP", "u2"), ("A/B", "TP", "u1")], "class_name string, kind string, uuid string")
    files.write_class_lists(lists, str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c/class_name=A_B/kind=TP")).collect()] == ["u1", "u2"]
    assert df.select(files.clip_json(["uuid", "n"]).alias("j")).first().j == '{"uuid":"u","n":1}'
