"""Drift of label files, against a plain implementation and on the cases the docstrings name."""

import json
from collections import defaultdict
from datetime import datetime

import pyarrow.parquet as pq

from reelgrid.operators import drift

DAY = lambda n: datetime(2026, 1, n)


def brute(records):
    def kind(v):
        if isinstance(v, bool):
            return "boolean"
        return {int: "integer", float: "number", str: "string", list: "array", dict: "object"}[type(v)]

    files = defaultdict(dict)
    for set_id, name, at, _, uuid, body in sorted(records, key=lambda r: r[3]):
        try:
            v = json.loads(body)
        except (TypeError, ValueError):
            continue
        if not isinstance(v, dict):
            continue
        for top in ("weather", "labeler"):
            if isinstance(v.get(top), dict):
                v = v | {f"{top}.{k}": x for k, x in v[top].items()}
        f = files[set_id].setdefault(name, {"at": at, "clips": {}, "fields": defaultdict(set)})
        f["at"] = min(f["at"], at)
        f["clips"][uuid] = v
        for k, x in v.items():
            f["fields"][k] |= set() if x is None else {kind(x)}
    out = set()
    for set_id, named in files.items():
        order = sorted(named.items(), key=lambda x: (x[1]["at"], x[0]))
        for (_, a), (name, b) in zip(order, order[1:]):
            gone, come = a["fields"].keys() - b["fields"].keys(), b["fields"].keys() - a["fields"].keys()
            used = set()
            for f in gone - {"weather", "labeler"}:
                for g in come - {"weather", "labeler"}:
                    pairs = [(a["clips"][u].get(f), b["clips"][u].get(g)) for u in a["clips"].keys() & b["clips"].keys()]
                    pairs = [p for p in pairs if p != (None, None)]
                    same = sum(x is not None and y is not None and kind(x) == kind(y) and x == y for x, y in pairs)
                    if pairs and same * 10 >= len(pairs) * 9:
                        out.add((set_id, name, "renamed", f, g))
                        used |= {f, g}
            out |= {(set_id, name, "removed", f, "") for f in gone - used} | {(set_id, name, "added", f, "") for f in come - used}
            out |= {(set_id, name, "retyped", f, "") for f in a["fields"].keys() & b["fields"].keys() if a["fields"][f] and b["fields"][f] and a["fields"][f] != b["fields"][f]}
    return out


SCHEMA = "set_id string, file_name string, written_at timestamp, line_no int, uuid string, body string"


def found(spark, records):
    return sorted(tuple(r) for r in drift.record_drift(spark.createDataFrame(records, SCHEMA)).collect())


def test_test_tables(spark):
    t = pq.read_table("/root/testdata/sf0.01/label_records.parquet")
    rows = list(zip(*(t.column(c).to_pylist() for c in ("set_id", "file_name", "written_at", "line_no", "uuid", "body"))))
    df = spark.read.parquet("/root/testdata/sf0.01/label_records.parquet")
    got = [tuple(r) for r in drift.record_drift(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_cases(spark):
    rows = []
    for i in range(10):
        rows.append(("s", "a", DAY(1), i, f"u{i}", json.dumps({"x": i, "w": 1.0, "k": None, "weather": {"p": i + 50}, "t": 1})))
        rows.append(("s", "b", DAY(2), i, f"u{i}", json.dumps({"y": i if i else 99, "w": 1, "k": None, "p": i + 50, "t": "1" if i == 3 else 1})))
    rows += [("s", "b", DAY(2), 20, "u1", None), ("s", "b", DAY(2), 21, "u2", '{"z": '), ("s", "b", DAY(2), 22, "u3", "[1]"), ("one", "a", DAY(1), 0, "u", "{}"), ("s", "c", DAY(3), 0, "u", "")]
    want = {("s", "b", "renamed", "x", "y"), ("s", "b", "renamed", "weather.p", "p"), ("s", "b", "removed", "weather", ""), ("s", "b", "retyped", "w", ""), ("s", "b", "retyped", "t", "")}
    assert set(found(spark, rows)) == want == brute(rows)


def test_empty(spark):
    assert found(spark, []) == []


def test_ingest_and_promote(spark):
    body = {"Rarity": 2, "note": 5, "Dynamic object": "3", "labeler": {"id": "l"}, "extra": {"a": [1, 2.50]}}
    rows = [("s", "a", DAY(1), 0, "u", json.dumps(body)), ("s", "a", DAY(1), 1, None, "broken"), ("s", "a", DAY(1), 2, "v", '{"Rarity": "odd"}')]
    read = drift.ingest(spark.createDataFrame(rows, SCHEMA).withColumn("rarity", __import__("pyspark").sql.functions.lit("clash")))
    out = {r.line_no: r for r in drift.promote(read, {"Rarity": "rarity"}).collect()}
    assert out[0]["Dynamic object"] == 3 and out[0].rarity == 2 and out[0].note is None
    assert json.loads(out[0]._rescued) == {"note": 5, "extra": {"a": [1, 2.5]}}
    assert not out[1]._readable and out[1]._rescued == "broken"
    assert out[2].rarity is None and json.loads(out[2]._rescued) == {"Rarity": "odd"}


def test_renamed_columns(spark):
    rows = []
    for i in range(10):
        rows.append(("s", "a", DAY(1), i, f"u{i}", json.dumps({"rarity": i, "weather": {"p": i + 50}, "is_night": True, "other": 3})))
        rows.append(("s", "b", DAY(2), i, f"u{i}", json.dumps({"how odd": i, "p": i + 50, "safety_criticality": 3})))
        rows.append(("s", "c", DAY(3), i, f"u{i}", json.dumps({"oddness": float(i) if i == 9 else i, "weather": {"q": 1}, "p": str(i), "safety_criticality": 3, "other": 3})))
    rows.append(("s", "c", DAY(3), 10, "v", json.dumps({"oddness": "--3", "p": 4})))
    read = drift.ingest(spark.createDataFrame(rows, SCHEMA)).cache()
    approved = drift.renamed_columns(read)
    assert approved == {"how odd": "rarity", "oddness": "rarity", "p": "weather.p"}
    out = {(r.file_name, r.line_no): r for r in drift.promote(read, approved).collect()}
    assert [out["b", i].rarity for i in range(10)] == [out["c", i].rarity for i in range(10)] == list(range(10))
    assert out["b", 3].weather == {"p": 53} and out["b", 3]._rescued is None
    assert out["c", 9].weather == {"q": 1, "p": 9} and json.loads(out["c", 9]._rescued) == {"other": 3}
    assert out["c", 10].weather == {"p": 4} and out["c", 10].rarity is None and json.loads(out["c", 10]._rescued) == {"oddness": "--3"}


def test_no_castable_value_of_a_renamed_field_stays(spark):
    from reelgrid.plans import problems

    names = {
        "Dynamic object": ("dynamic_object", "DynamicObject", "Dynamic Object"), "Driving environment": ("driving_environment", "DrivingEnvironment", "driving env"),
        "safety_criticality": ("criticality", "safetyCriticality", "safety_critical_level"), "rarity": ("Rarity", "rarity_score", "how_rare"),
        "classes": ("class_list", "categories"), "influenced_ego": ("ego_influenced",), "is_night": ("night",), "rain_snow_fog": ("precip_tags",), "note": ("comment", "notes"),
        "weather": ("precipitation", "road_surface", "illumination", "atmospheric_obscurants"), "labeler": ("labeled_by", "labeler_id"),
    }
    folder = "/root/testdata/sf0.1"
    rows = problems.p3_table(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/label_records.parquet").count()
    left = set()
    for r in rows:
        rest = drift._load(r._rescued) or {}
        for column, aliases in names.items():
            kind = {"weather": "int", "labeler": "string"}.get(column, drift.LABEL_SCHEMA[column])
            left |= {f for f in aliases if f in rest and drift._cast(rest[f], kind) is not None}
    assert not left


def test_odd_values_are_kept(spark):
    digits = "9" * 6_000
    bodies = [
        r'{"note": "a \ud83d", "rarity": "+-5", "\ud83d": 1, "labeler": {"id": "\ude00"}, "classes": ["\ud83d"]}',
        f'{{"rarity": {digits}, "safety_criticality": "0000000000003", "is_night": null}}',
        '{"rarity": 2.0, "weather": {"p": "2", "q": null}, "note": "tab\\t \\" \\\\ \\u0001"}',
    ]
    rows = [("s", "a", DAY(1), i, f"u{i}", body) for i, body in enumerate(bodies)] + [("s", "b", DAY(2), i, f"u{i}", body) for i, body in enumerate(bodies)]
    read = drift.ingest(spark.createDataFrame(rows, SCHEMA)).where("file_name = 'a'").cache()
    raw = {r.line_no: r for r in read.collect()}
    with drift._any_digits():
        kept = [drift._load(body) for body in bodies]
        assert all(r._readable for r in raw.values())
        assert drift._load(raw[0]._rescued) == kept[0] and drift._load(raw[1]._rescued) == kept[1]
        out = {r.line_no: r for r in drift.promote(read, {}).collect()}
        assert drift._load(out[0]._rescued) == kept[0]
        assert out[1].safety_criticality == 3 and drift._load(out[1]._rescued) == {"rarity": int(digits)}
    assert out[2].rarity == 2 and out[2].weather == {"p": 2, "q": None} and out[2].note == "tab\t \" \\ \x01" and out[2]._rescued is None
    assert found(spark, rows) == []


def test_typed_and_rescued_values_compare(spark):
    """A value has one hash whether it stands in a column or in _rescued."""
    odd = ["q\"\\/\x01 é😀", "b"]
    one, two = {"classes": odd, "note": odd[0], "rarity": -7, "is_night": False, "weather": {"é": 1, "a": None, "B": 3}}, {"x": odd, "y": odd[0], "z": -7, "n": False}
    rows = [("s", f, DAY(d), 0, "u", json.dumps(v)) for d, (f, v) in enumerate((("a", one), ("b", two), ("c", one)), 1)]
    want = {(f, "renamed", *sorted(p, key=lambda x: x in two, reverse=f == "c")) for f in "bc" for p in (("classes", "x"), ("note", "y"), ("rarity", "z"), ("is_night", "n"))}
    got = {r[1:] for r in found(spark, rows)}
    assert want <= got and {k for _, k, *_ in got - want} == {"removed", "added"}
    assert set(found(spark, rows)) == brute(rows)
    same = [("s", "a", DAY(1), 0, "u", json.dumps({"k": one})), ("s", "b", DAY(2), 0, "u", json.dumps({"j": one}))]
    assert found(spark, same) == [("s", "b", "renamed", "k", "j")]
