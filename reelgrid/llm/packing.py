"""Filling containers of fixed capacity with documents (problem 7).

Mixture-controlled packing: documents wait in queues, one for each source.  A window is a
run of containers; at its start each source is credited its target share of the window's
tokens, and each placed piece is debited, so what a source got too little of (its deficit)
is carried on.  Sources are visited in turn, from container to container.  One that has a
deficit places its largest pieces that still fit, up to its quantum for a visit; when no
source with a deficit has any that fits, the room that is left is filled on credit, by the
source with the least of it that has a piece that fits.  So windows keep the target proportions and containers get full.
A document larger than the capacity waits as its pieces, which are placed as any others.

The target shares are the corpus' own, or given.  Documents are dealt by hash to shards of
about `shard_rows`; shards are packed independently.  What a shard owes or got in advance is
known from token totals alone: the deficits with which it starts are prefix sums over the
shards before it.  A source that holds a third of all rows is spread over all shards like
any other.  With given shares every document is still placed: windows keep them as long as
all sources last, and each shard starts anew, as what another lacked it can't make up for.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reelgrid.llm.bpe import TOKENIZERS, arrived, blocks, byte_bpe, ship
from reelgrid.llm.pieces import pieces
from reelgrid.session import cut

SHARD_ROWS = 20_000
#: Containers of a window.
WINDOW = 16
#: Rows that the table of targets may have; it is read to the driver.
MAX_TARGETS = 1_000

PLACED = "target_id int, container_id bigint, pos int, doc_id {id}, piece_no int, from_token bigint, n_tokens int"


def counter(path: str):
    """A function from texts to token counts, for a tokenizer's file."""
    path = arrived(path)
    if path.endswith(".tiktoken"):
        return byte_bpe(path).count
    if path.endswith(".model"):
        return pieces(path).count
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: np.array([len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)], np.int64)


def token_sizes(docs: DataFrame, tokenizers: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, source and sizes (tokens by each tokenizer); null texts have none, null sources are ''."""

    paths = [ship(docs.sparkSession, folder, t) for t in tokenizers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [counter(p) for p in paths]
        for b in batches:
            done = 0
            for block in blocks(b.column("text").to_pylist()):
                found = np.stack([c(block) for c in count], axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * len(count)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(done, len(block)), b.column("source").slice(done, len(block)), lists], names=["doc_id", "source", "sizes"])
                done += len(block)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").mapInArrow(run, f"doc_id {kind}, source string, sizes array<int>")


class _Queue:
    """A source's pieces in the order of their size."""

    def __init__(self) -> None:
        self.pieces: list[tuple[int, int, int, int]] = []

    def fitting(self, free: int) -> int:
        """Where the largest piece of at most free tokens stands; -1 if there is none."""
        return bisect_right(self.pieces, (free, float("inf"))) - 1


def pack(items: list[tuple[int, int, str]], capacity: int, owed: Mapping[str, float], shares: Mapping[str, float], window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(container, pos, item, piece, from, tokens) of each piece.

    items: (size, item number, source).  An item larger than the capacity is divided into
    pieces of the capacity and a rest; nothing else is divided.  Items of no tokens lie in
    container 0.  owed: deficits at the start; shares: the target shares, of which those of
    sources that have nothing left fall to the others.
    """
    queues: dict[str, _Queue] = {}
    empty = []
    for size, item, source in items:
        if not size:
            empty.append(item)
        for piece in range(-(-size // capacity)):
            start = piece * capacity
            queues.setdefault(source, _Queue()).pieces.append((min(capacity, size - start), item, piece, start))
    waiting = {s: sum(x[0] for x in q.pieces) for s, q in queues.items()}
    for q in queues.values():
        q.pieces.sort()
    turn = sorted(queues)
    deficit = {s: owed.get(s, 0.0) for s in turn}
    number, of_first = 0, 0
    while turn:
        if number % window == 0:
            weights = {s: shares.get(s, 0.0) for s in turn}
            if not sum(weights.values()):
                weights = dict(waiting)
            room = min(window * capacity, sum(waiting.values())) / sum(weights.values())
            for s in turn:
                deficit[s] += weights[s] * room
            quantum = {s: max(1.0, capacity * weights[s] / sum(weights.values())) for s in turn}
        free, pos = capacity, 0

        def place(s: str, k: int) -> tuple[int, int, int, int, int, int]:
            nonlocal free, pos
            size, item, piece, start = queues[s].pieces.pop(k)
            waiting[s] -= size
            deficit[s] -= size
            free -= size
            pos += 1
            return number, pos - 1, item, piece, start, size

        visits = 0  # in a row without a piece placed
        while free and visits < len(turn):
            s = turn.pop(0)
            turn.append(s)
            visits += 1
            left = quantum[s]
            while left > 0 and deficit[s] > 0 and (k := queues[s].fitting(free)) >= 0:
                out = place(s, k)
                left -= out[-1]
                visits = 0
                yield out
        while free and (fits := [s for s in turn if queues[s].fitting(free) >= 0]):
            s = max(fits, key=deficit.__getitem__)
            yield place(s, queues[s].fitting(free))
        turn = [s for s in turn if queues[s].pieces]
        of_first = of_first or pos
        number += 1
    for k, item in enumerate(empty):
        yield 0, of_first + k, item, 0, 0, 0


def _pack_shard(ids: pa.DataType, window: int, key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    target, shard = key[0].as_py(), key[1].as_py()
    owed = dict(zip(right.column("source").to_pylist(), right.column("owed").to_pylist(), strict=True))
    shares = dict(zip(right.column("source").to_pylist(), right.column("share").to_pylist(), strict=True))
    # in one order, whatever order the shuffle brings them in
    left = left.sort_by([("size", "ascending"), ("doc_id", "ascending")])
    docs = left.column("doc_id").combine_chunks()
    items = list(zip(left.column("size").to_pylist(), range(left.num_rows), left.column("source").to_pylist(), strict=True))
    if not items:
        return pa.table({c: pa.array([], t) for c, t in (("target_id", pa.int32()), ("container_id", pa.int64()), ("pos", pa.int32()), ("doc_id", ids), ("piece_no", pa.int32()), ("from_token", pa.int64()), ("n_tokens", pa.int32()))})
    out = np.array(list(pack(items, left.column("capacity")[0].as_py(), owed, shares, window)), np.int64)
    if isinstance(docs, pa.ChunkedArray):
        docs = pa.concat_arrays(docs.chunks)
    return pa.table(
        {
            "target_id": pa.array(np.full(len(out), target), pa.int32()),
            "container_id": pa.array((shard << 32) + out[:, 0]),
            "pos": pa.array(out[:, 1].astype(np.int32)),
            "doc_id": docs.take(pa.array(out[:, 2])).cast(ids),
            "piece_no": pa.array(out[:, 3].astype(np.int32)),
            "from_token": pa.array(out[:, 4]),
            "n_tokens": pa.array(out[:, 5].astype(np.int32)),
        }
    )


def pack_documents(docs: DataFrame, targets: DataFrame, *, shares: Mapping[str, float] | None = None, folder: str = TOKENIZERS, shard_rows: int = SHARD_ROWS, window: int = WINDOW) -> DataFrame:
    """target_id, container_id, pos, doc_id, piece_no, from_token, n_tokens: where each piece lies.

    shares: target proportion of each source (they needn't sum to 1; sources not named come
    last), the corpus' own if none are given.  container_id is the shard, shifted by 32 bits,
    plus the number of the container in it; of every `window` numbers one window is made.
    Every row of docs is placed once for each target, repeated rows and those without text
    (no tokens) too.  Targets with null tokenizer or without positive capacity, and empty
    tables, give no rows.
    """
    rows = targets.select("target_id", "tokenizer", "capacity").where("tokenizer IS NOT NULL AND capacity > 0").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    names = sorted({r.tokenizer for r in rows})
    schema = PLACED.format(id=docs.schema["doc_id"].dataType.simpleString())
    if not rows:
        return docs.sparkSession.createDataFrame([], schema)
    sizes = cut(token_sizes(docs, names, folder))
    shards = max(1, -(-sizes.count() // shard_rows))
    wanted = F.array(*[F.struct(F.lit(r.target_id).cast("int").alias("target_id"), F.lit(r.capacity).cast("int").alias("capacity"), F.col("sizes")[names.index(r.tokenizer)].alias("size")) for r in rows])
    items = sizes.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "doc_id", "source", F.explode(wanted).alias("t")).select("t.target_id", "shard", "doc_id", "source", "t.capacity", "t.size")

    totals = cut(items.groupBy("target_id", "shard", "source").agg(F.sum("size").alias("tokens")))
    if shares is None:
        wanted = corpus_shares(totals)
    else:
        given_shares = F.create_map(*[F.lit(x) for s, n in shares.items() for x in (s, float(n))])
        wanted = totals.select("target_id", "source").distinct().withColumn("share", F.coalesce(F.try_element_at(given_shares, F.col("source")), F.lit(0.0)))
    by_shard = totals.groupBy("target_id", "shard").agg(F.sum("tokens").alias("shard_tokens"))
    line = lambda *by: Window.partitionBy(*by).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    due = by_shard.withColumn("due", F.coalesce(F.sum("shard_tokens").over(line("target_id")), F.lit(0))).drop("shard_tokens")
    given = totals.withColumn("given", F.coalesce(F.sum("tokens").over(line("target_id", "source")), F.lit(0)))
    owes = F.col("share") * F.col("due") - F.col("given") if shares is None else F.lit(0.0)
    owed = given.join(due, ["target_id", "shard"]).join(wanted, ["target_id", "source"]).select("target_id", "shard", "source", "share", owes.alias("owed"))

    ids = to_arrow_type(docs.schema["doc_id"].dataType)
    return items.groupBy("target_id", "shard").cogroup(owed.groupBy("target_id", "shard")).applyInArrow(partial(_pack_shard, ids, window), schema)


def corpus_shares(tokens: DataFrame) -> DataFrame:
    """target_id, source, share: proportions of token counts (target_id, source, tokens)."""
    every = tokens.groupBy("target_id").agg(F.sum("tokens").alias("every"))
    own = tokens.groupBy("target_id", "source").agg(F.sum("tokens").alias("own"))
    return own.join(every, "target_id").select("target_id", "source", F.coalesce(F.try_divide("own", "every"), F.lit(0.0)).alias("share"))


def mixture_report(placed: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """target_id, windows, mean_error and greatest_error: how far windows are from the corpus' proportions.

    A window's error is the greatest distance of a source's share of its tokens from the
    source's share of all; the last window of a shard, which holds what is left, doesn't count.
    """
    source = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source")).dropDuplicates(["doc_id"])
    at = [F.shiftright("container_id", 32).alias("shard"), F.floor(F.col("container_id").bitwiseAND(F.lit(0xFFFFFFFF)) / window).alias("window")]
    tokens = cut(placed.select("target_id", *at, "doc_id", "n_tokens").join(source, "doc_id").groupBy("target_id", "shard", "window", "source").agg(F.sum("n_tokens").alias("tokens")))
    windows = tokens.groupBy("target_id", "shard", "window").agg(F.sum("tokens").alias("every"))
    last = Window.partitionBy("target_id", "shard")
    whole = windows.withColumn("last", F.max("window").over(last)).where("window < last AND every > 0").drop("last")
    cells = whole.join(corpus_shares(tokens), "target_id").join(tokens, ["target_id", "shard", "window", "source"], "left")
    errors = cells.groupBy("target_id", "shard", "window").agg(F.max(F.abs(F.coalesce("tokens", F.lit(0)) / F.col("every") - F.col("share"))).alias("error"))
    return errors.groupBy("target_id").agg(F.count(F.lit(1)).alias("windows"), F.avg("error").alias("mean_error"), F.max("error").alias("greatest_error"))


def broken_rules(placed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id, n_documents, n_missing, n_double, n_overfull, n_divided: rules that a packing must keep.

    Documents are told by doc_id; of each, pieces must follow each other from the first
    token on, once, and only one that is larger than the capacity may have several.
    """
    sizes = targets.where("tokenizer IS NOT NULL AND capacity > 0").select("target_id", "capacity")
    of_doc = placed.groupBy("target_id", "doc_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max("piece_no").alias("last"), F.count_distinct("piece_no").alias("different"), F.max(F.col("from_token") + F.col("n_tokens")).alias("end")
    )
    docs_ok = of_doc.join(sizes, "target_id").groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count_if((F.col("different") < F.col("pieces")) | (F.col("last") + 1 != F.col("pieces")) | (F.col("end") != F.col("tokens"))).alias("n_double"),
        F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("n_divided"),
    )
    full = placed.groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("used")).join(sizes, "target_id").groupBy("target_id").agg(F.count_if(F.col("used") > F.col("capacity")).alias("n_overfull"))
    every = docs.select("doc_id").distinct().count()
    return docs_ok.join(full, "target_id").select("target_id", "n_documents", (F.lit(every) - F.col("n_documents")).alias("n_missing"), "n_double", "n_overfull", "n_divided")


def fill_report(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id, containers, tokens and fill, the share of the containers' room that is used."""
    per = placed.groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("used"))
    return per.groupBy("target_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens")).join(targets.select("target_id", "capacity"), "target_id").select("target_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
