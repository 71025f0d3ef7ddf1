"""Periods and gaps, against a plain implementation."""

import pyarrow.parquet as pq
from hypothesis import given
from hypothesis import strategies as st

from reelgrid.operators import intervals as iv

SPANS = st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)).map(lambda x: (x[0], x[0] + x[1])), max_size=12)


def cover(spans):
    """Half-steps covered by the spans, so that touching spans show as joined."""
    return {x for s, e in spans for x in range(2 * s, 2 * e + 1)}


@given(SPANS, SPANS)
def test_merge(a, b):
    out = iv.merge(iv.coalesce(a), iv.coalesce(b))
    assert cover(out) == cover(a) | cover(b)
    assert all(x[1] < y[0] for x, y in zip(out, out[1:]))


@given(st.lists(SPANS, max_size=7))
def test_tree(lists):
    assert iv.reduce_tree([iv.coalesce(x) for x in lists]) == iv.coalesce(s for x in lists for s in x)


def test_forms():
    p = iv.parse_spans
    assert p([1, 2, 3, 4, 5, 6]) == [(1000, 2000), (4000, 5000)]
    assert p([1, 2, 3, 4]) == [(1000, 2000), (3000, 4000)]
    assert p([[3, 1], [2, 2], [-1, 4], [True, 4], [None, 4], [1, 2, "x"]]) == [(1000, 3000), (1000, 2000)]
    assert p({"start": "0:37.2", "end": "64 s"}) == [(37200, 64000)]
    assert p(["from 24.5 to 53 seconds", "12 s to 10 s", "0:01-0:02.5", "7.5", "-3 - 5"]) == [(24500, 53000), (10000, 12000), (1000, 2500)]
    assert p(["0:15", "0:18"]) == [(15000, 18000)]
    assert p({"start": 4}) == p("nothing") == p(None) == p(3) == []


def test_test_tables(spark):
    folder = "/root/testdata/sf0.01"
    names = {n.strip().lower(): n for n in pq.read_table(f"{folder}/taxonomy.parquet").column("class_name").to_pylist()}
    t = pq.read_table(f"{folder}/clip_results.parquet", columns=["uuid", "time_spans"]).to_pydict()
    every = {}
    for u, text in zip(t["uuid"], t["time_spans"]):
        for name, spans in iv.parse_time_spans(text):
            if name.strip().lower() in names:
                every.setdefault((u, names[name.strip().lower()]), []).extend(spans)
    want = set()
    for (u, c), spans in every.items():
        line = iv.coalesce(spans)
        want |= {(u, c, "period", s, e) for s, e in line} | {(u, c, "gap", a[1], b[0]) for a, b in zip(line, line[1:])}
    rows = spark.read.parquet(f"{folder}/clip_results.parquet")
    got = [tuple(r) for r in iv.span_periods(rows, spark.read.parquet(f"{folder}/taxonomy.parquet")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_edges(spark):
    taxonomy = spark.createDataFrame([("Roadworks",), (None,)], "class_name string")
    rows = [("a", '{" ROADWORKS ": [[1, 2], [2, 3]], "other": [[1, 9]]}'), ("a", '[{"type": "Roadworks", "spans": [[5, 6]]}]')] * 3 + [("a", '{"Roadworks": [[1,'), ("b", None), (None, '{"Roadworks": [[1, 2]]}'), ("c", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "uuid string, time_spans string, class_name string")
    got = sorted(tuple(r) for r in iv.span_periods(df, taxonomy).collect())
    assert got == [("a", "Roadworks", "gap", 3000, 5000), ("a", "Roadworks", "period", 1000, 3000), ("a", "Roadworks", "period", 5000, 6000)]
    assert iv.span_periods(df.limit(0), taxonomy).count() == 0
