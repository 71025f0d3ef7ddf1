"""Packing: proportions by window, shares that are given, pieces of large documents, many shards."""

import random
from collections import Counter, defaultdict

from reelgrid.llm import packing


def windows(placed, of, window=packing.WINDOW):
    got = defaultdict(Counter)
    for container, _, item, _, _, n in placed:
        got[container // window][of[item]] += n
    return [got[w] for w in sorted(got)]


def test_given_shares_hold_while_all_sources_last():
    rnd = random.Random(11)
    items = [(rnd.randint(1, 300), i, rnd.choice("abc")) for i in range(9_000)]
    of = {i: s for _, i, s in items}
    placed = list(packing.pack(items, 512, {}, {"a": 0.6, "b": 0.3, "c": 0.1}))
    assert sorted(x[2] for x in placed) == list(range(9_000))
    total = Counter()
    for n, _, s in items:
        total[s] += n
    lasts = int(total["a"] / 0.6 / 512 / packing.WINDOW) - 1
    for w in windows(placed, of)[:lasts]:
        every = w.total()
        assert all(abs(w[s] / every - x) < 0.12 for s, x in (("a", 0.6), ("b", 0.3), ("c", 0.1)))


def test_large_documents_are_part_of_the_windows():
    rnd = random.Random(12)
    items = [(rnd.randint(1, 300), i, "ab"[i % 2]) for i in range(8_000)] + [(4_000, 8_000 + i, "c") for i in range(60)]
    of = {i: s for _, i, s in items}
    every = sum(n for n, _, _ in items)
    shares = {s: sum(n for n, i, _ in items if of[i] == s) / every for s in "abc"}
    placed = list(packing.pack(items, 512, {}, shares))
    errors = [max(abs(w[s] / w.total() - shares[s]) for s in "abc") for w in windows(placed, of)[:-2]]
    assert max(errors) < 2 / packing.WINDOW and sum(errors) < 0.04 * len(errors)


def test_owed_tokens_come_first():
    items = [(10, i, "ab"[i % 2]) for i in range(400)]
    of = {i: s for _, i, s in items}
    first = windows(packing.pack(items, 100, {"a": 300.0, "b": -300.0}, {"a": 0.5, "b": 0.5}, 10), of, 10)[0]
    assert first["a"] - first["b"] >= 500


def test_sources_without_share_come_last():
    items = [(10, i, "ab"[i % 2]) for i in range(40)]
    placed = list(packing.pack(items, 100, {}, {"a": 1.0}))
    assert [i % 2 for _, _, i, *_ in placed] == [0] * 20 + [1] * 20
    assert list(packing.pack([], 10, {}, {})) == [] and list(packing.pack([(0, 0, "a")], 10, {}, {})) == [(0, 0, 0, 0, 0, 0)]


def test_shards_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    targets = spark.createDataFrame([(1, "byte_bpe_50k", 4096)], "target_id int, tokenizer string, capacity int")
    placed = packing.pack_documents(docs, targets, shard_rows=2_500, window=16).cache()
    rules = packing.broken_rules(placed, docs, targets).first()
    assert (rules.n_documents, rules.n_missing, rules.n_double, rules.n_overfull, rules.n_divided) == (docs.count(), 0, 0, 0, 0)
    assert packing.fill_report(placed, targets).first().fill > 0.99
    mixture = packing.mixture_report(placed, docs).first()
    assert mixture.windows > 20 and mixture.mean_error < 0.05, mixture
