"""Streams against their batch twins."""

import json
import time

import pytest

from reelgrid.streaming import store


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_fold_and_poll(spark, tmp_path):
    events = [{"seq": i, "ts": "t", "user": f"u{i % 3}", "uuid": f"c{i % 7}", "action": "update", "rev": 1, "after": str(i)} for i in range(40)]
    src = tmp_path / "in"
    src.mkdir()
    for k in range(4):
        part = events[k::4][::-1]
        (src / f"{k}.jsonl").write_text("".join(json.dumps(e) + "\n" for e in part) + '{"seq": 99, "uu')
    stream = store.read_log_stream(spark, str(src), per_trigger=1)
    q = store.fold_stream(stream).writeStream.format("memory").queryName("folded").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.uuid: (r.seq, r.after, r.n_events) for r in spark.table("folded").collect()}
    want = {}
    for e in events:
        want[e["uuid"]] = (e["seq"], e["after"], sum(x["uuid"] == e["uuid"] for x in events))
    assert got == want
    seen = []
    q = store.poll_stream(stream, 30, lambda df: seen.extend(r.uuid for r in df.collect()), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    assert set(seen) == {e["uuid"] for e in events if e["seq"] > 30}


def test_claims(spark, tmp_path):
    src = tmp_path / "claims"
    src.mkdir()
    rows = [("a", "c1", 1), ("b", "c2", 2), ("a", "c3", 4), ("a", "c2", 3)]
    (src / "0.json").write_text("".join(json.dumps({"user_id": u, "uuid": c, "seq": s}) + "\n" for u, c, s in rows))
    stream = spark.readStream.schema("user_id string, uuid string, seq bigint").json(str(src))
    q = store.claims_stream(stream).writeStream.format("memory").queryName("claims").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    for _ in range(60):  # a query with timers never runs out of work
        if spark.table("claims").where("uuid = 'c3'").count() and spark.table("claims").where("uuid = 'c2'").count():
            break
        time.sleep(0.5)
    q.stop()
    assert {(r.user_id, r.uuid) for r in spark.table("claims").where("held").collect()} == {("a", "c3"), ("b", "c2")}


def test_progress(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/0.json").write_text('{"x": 1}\n{"x": 2}\n')
    log = store.ProgressLog()
    spark.streams.addListener(log)
    try:
        q = spark.readStream.schema("x int").json(str(tmp_path / "in")).writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        for _ in range(60):
            if "counted" in log.ended:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(log)
    assert log.rows == {"counted": 2} and log.ended == {"counted"}
