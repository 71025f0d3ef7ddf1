"""Encoding and token counts against the public libraries, and packing's rules."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from reelgrid.llm import bpe, packing, pretokens
from reelgrid.llm.pieces import Pieces

HERE = bpe.TOKENIZERS
ALPHABET = " \n\t'strevmld'A1,.! é中<|endoftext|>\0  　ª²"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(f"{HERE}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBpe(f"{HERE}/byte_bpe_50k.tiktoken")


def encoded(own, texts):
    ids, at = own.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_random_texts(library, own):
    random.seed(1)
    texts = ["".join(random.choices(ALPHABET, k=random.randint(0, 30))) for _ in range(20_000)]
    assert encoded(own, texts) == library(texts)


def test_every_codepoint(library, own):
    texts = [f"a{c}1 {c}{c} b'{c}" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"][::7]
    assert encoded(own, texts) == library(texts)


def test_long_runs(library, own):
    texts = ["=" * 50_000, " " * 9_999 + "x", "ab" * 20_000, "あ" * 5_000, ""]
    assert encoded(own, texts) == library(texts)


def test_scan_is_the_loop():
    ids, table, images, _ = pretokens.monoid()
    rng = np.random.default_rng(0)
    syms = rng.integers(0, 9, 70_000).astype(np.uint8)
    state, want = 0, []
    for x in syms:
        want.append(state)
        state = pretokens._step(state, int(x))[0]
    assert images[:, 0][pretokens.scan(ids[syms], table)].tolist() == want
    for a in range(len(table)):
        for b in range(len(table)):
            assert (table[table[a, b]] == table[a, table[b]]).all()


def test_round_trip_and_offsets(spark, own):
    rows = [(1, "Hé said 'tis <|endoftext|> 中文 x\n\n y"), (2, ""), (3, None), (1, "again"), (4, " " * 70_000)]
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "doc_id long, text string, ids string, ends int")
    out = bpe.encode(df, offsets=True).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id, own.decode(r.ids)) for r in out) == sorted((i, t or "") for i, t in rows)
    for r in out:
        raw = own.decode(r.ids).encode()
        at = [0, *r.ends]
        assert [raw[a:b] for a, b in zip(at, at[1:])] == [own.tokens[i] for i in r.ids]
    assert bpe.encode(df.limit(0)).collect() == []


def test_test_tables(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in rows), library([r.text or "" for r in rows])))
    got = bpe.encode(df).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(rows)


def test_piece_counts():
    random.seed(2)
    p = Pieces(f"{HERE}/piece_bpe_32k.model")
    assert p.apart
    texts = ["".join(random.choices(ALPHABET + "▁<s>", k=random.randint(0, 30))) for _ in range(20_000)]
    assert p.count(texts).tolist() == [len(x) for x in p.model.encode(texts)]


def check(placed, sizes, capacity):
    """Every item whole and once, no container beyond its capacity."""
    used, parts = Counter(), defaultdict(list)
    for container, _, item, piece, start, n in placed:
        used[container] += n
        parts[item].append((piece, start, n))
    assert max(used.values(), default=0) <= capacity
    assert sorted(parts) == list(range(len(sizes)))
    for item, pieces in parts.items():
        pieces.sort()
        assert len(pieces) == 1 or sizes[item] > capacity
        assert [p for p, _, _ in pieces] == list(range(len(pieces)))
        assert [s for _, s, _ in pieces] == [sum(n for _, _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, _, n in pieces) == sizes[item]
    assert len({(c, p) for c, p, *_ in placed}) == len(placed)
    return used


def test_pack():
    random.seed(3)
    for _ in range(50):
        sizes = [random.choice([0, 1, 5, 30, 64, 65, 128, 129, 400]) for _ in range(random.randint(0, 60))]
        items = [(n, i, random.choice("abc")) for i, n in enumerate(sizes)]
        used = check(list(packing.pack(items, 64, {}, {"a": 0.5, "b": 0.3, "c": 0.2}, 4)), sizes, 64)
        assert sum(u < 32 for u in used.values()) <= 1 or not sizes


def test_mixture():
    random.seed(4)
    sources = random.choices("abcd", [0.4, 0.3, 0.2, 0.1], k=6_000)
    items = [(random.randint(1, 300), i, s) for i, s in enumerate(sources)]
    total = sum(n for n, _, _ in items)
    shares = {s: sum(n for n, _, t in items if t == s) / total for s in "abcd"}
    of = dict(zip(range(len(items)), sources))
    got = defaultdict(Counter)
    for container, _, item, _, _, n in packing.pack(items, 512, {}, shares):
        got[container // packing.WINDOW][of[item]] += n
    full = sorted(got)[:-3]
    far = [abs(got[w][s] / sum(got[w].values()) - shares[s]) for w in full for s in "abcd"]
    assert max(far) < 0.06


def test_packed_tables(spark):
    schema = "doc_id long, source string, text string, target_id int"
    rows = [(1, "a", "word " * 3000, 9), (2, None, None, 9), (3, "b", "", 9), (4, "b", "short text", 9), (4, "b", "short text", 9)]
    docs = spark.createDataFrame(rows, schema)
    targets = spark.createDataFrame([(1, "byte_bpe_50k", 512), (2, "piece_bpe_32k", 700), (3, "word_bpe_49k", 100), (4, None, 10), (5, "byte_bpe_50k", 0)], "target_id int, tokenizer string, capacity int")
    placed = packing.pack_documents(docs, targets, shard_rows=2)
    out = placed.collect()
    for target, capacity in ((1, 512), (2, 700), (3, 100)):
        mine = [r for r in out if r.target_id == target]
        assert Counter(r.doc_id for r in mine if r.piece_no == 0) == {1: 1, 2: 1, 3: 1, 4: 2}
        used = Counter()
        for r in mine:
            used[r.container_id] += r.n_tokens
        assert max(used.values()) <= capacity
    assert {r.target_id for r in out} == {1, 2, 3}
    assert packing.pack_documents(docs.limit(0), targets).count() == 0
    assert packing.pack_documents(docs, targets.limit(0)).count() == 0


def test_vocabulary_is_sent_along(spark):
    from reelgrid.llm.bpe import arrived, ship

    ship(spark, HERE, "byte_bpe_50k")
    there = "/nowhere/byte_bpe_50k.tiktoken"
    assert spark.range(1).mapInPandas(lambda it: (b.assign(id=len(open(arrived(there)).readline()) > 0) for b in it), "id boolean").first().id
    with pytest.raises(FileNotFoundError):
        ship(spark, HERE, "missing")
