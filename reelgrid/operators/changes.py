"""Applying a feed of inserts, updates and deletes (problem 2).

Every change carries a sequence, the order in which changes of its key take effect.  An
embedded DuckDB holds, for one bucket of keys at a time, the latest change of each key;
a change is upserted, and on conflict it is taken only if its sequence is higher than the
stored one.  Deletes stay as tombstones with their sequence, so a late older insert can't
revive a key.  Repeated and out-of-order changes therefore leave the state they should.

A key is a name and a number, and a change covers a range of numbers.  Ranges are divided at
multiples of `BLOCK` only.  A piece that covers a whole block is one row of its own key in the
upsert; of other pieces each number is a row, and what is passed on are ranges again.  A
block and its numbers meet in one bucket, where of a number's own change and its block's
the later one counts.

The upsert runs twice.  First within each task over the rows it read, so a key with a
third of all changes is down to one row a task (or one for every `HELD` bytes) before
anything is shuffled; then over the shuffled rows, sorted by bucket, one bucket in memory
at a time.  There are as many buckets as the counted sizes need to stay under `HELD` each;
nothing is spilled to the machine's own disk.

`publish` writes the exported buckets aside and makes them visible by creating one file that
must not exist yet.  `apply_feed` works a feed into the published state, of which tombstones
and sequences are part, and starts again if another writer was faster.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions.chunks import WIDEST, ranges
from reelgrid.functions.text import strip
from reelgrid.session import cut, shuffle_width

#: Numbers of a block.
BLOCK = 4096
#: Bytes of changes that a task holds before it passes on what it has, and that a bucket should have.
HELD = 16_000_000
#: Bytes that a number takes beside its texts.
ROW = 64
MEMORY = "400MB"
#: Writers that may come before one, each time it tries to publish.
TRIES = 100

_SEQ = "t bigint, tie bigint, ev string, step tinyint, v string"
#: A change: name, first and last number (within one block), sequence, value (null: delete).
CHANGE = f"k string, lo bigint, hi bigint, {_SEQ}"
_ARROW = pa.schema([("k", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("t", pa.int64()), ("tie", pa.int64()), ("ev", pa.string()), ("step", pa.int8()), ("v", pa.string())])

# n: the number, or -1 - b for the whole of block b
_TABLE = "CREATE TABLE state (k VARCHAR, n BIGINT, t BIGINT, tie BIGINT, ev VARCHAR, step TINYINT, v VARCHAR, PRIMARY KEY (k, n))"
_AT = "({0}.t, {0}.tie, {0}.ev, {0}.step, {0}.v IS NOT NULL, coalesce({0}.v, ''))"
_UPSERT = f"""
INSERT INTO state
SELECT k, n, s.t, s.tie, s.ev, s.step, s.v FROM (
  SELECT k, n, arg_max(r, {{'t': r.t, 'tie': r.tie, 'ev': r.ev, 'step': r.step, 'has': r.v IS NOT NULL, 'v': coalesce(r.v, '')}}) AS s FROM (
    SELECT k, unnest(CASE WHEN hi - lo + 1 = {BLOCK} THEN [-1 - lo // {BLOCK}] ELSE range(lo, hi + 1) END) AS n, {{'t': t, 'tie': tie, 'ev': ev, 'step': step, 'v': v}} AS r FROM batch)
  GROUP BY k, n)
ON CONFLICT (k, n) DO UPDATE SET t = excluded.t, tie = excluded.tie, ev = excluded.ev, step = excluded.step, v = excluded.v
WHERE {_AT.format("excluded")} > {_AT.format("state")}
"""
_RUNS = f"""
SELECT k, min(n) AS lo, max(n) AS hi, t, tie, ev, step, v
FROM (SELECT *, n - row_number() OVER (PARTITION BY k, n // {BLOCK}, t, tie, ev, step, v ORDER BY n) AS g FROM {{0}})
GROUP BY k, n // {BLOCK}, t, tie, ev, step, v, g"""
#: What a task passes on: numbers as ranges, whole blocks as they are.
_PARTIAL = f"""
{_RUNS.format("(FROM state WHERE n >= 0)")}
UNION ALL SELECT k, (-1 - n) * {BLOCK}, (-1 - n) * {BLOCK} + {BLOCK} - 1, t, tie, ev, step, v FROM state WHERE n < 0"""
#: A bucket's result: disjoint ranges, each with the latest change that covers it.
_FINAL = f"""
WITH whole AS (SELECT k, -1 - n AS b, t, tie, ev, step, v FROM state WHERE n < 0),
own AS (
  SELECT s.* FROM (SELECT *, n // {BLOCK} AS b FROM state WHERE n >= 0) s LEFT JOIN whole w ON w.k = s.k AND w.b = s.b
  WHERE w.k IS NULL OR {_AT.format("s")} > {_AT.format("w")}),
broken AS (SELECT * FROM whole SEMI JOIN own USING (k, b)),
rest AS (SELECT * FROM (SELECT k, unnest(range(b * {BLOCK}, b * {BLOCK} + {BLOCK})) AS n, t, tie, ev, step, v FROM broken) ANTI JOIN own USING (k, n))
{_RUNS.format("(SELECT k, n, t, tie, ev, step, v FROM own UNION ALL FROM rest)")}
UNION ALL SELECT k, b * {BLOCK}, b * {BLOCK} + {BLOCK} - 1, t, tie, ev, step, v FROM whole ANTI JOIN own USING (k, b)"""


class _Bucket:
    """The state of one bucket, in an embedded DuckDB."""

    def __init__(self) -> None:
        import duckdb

        self.db = duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": ""})
        self.db.execute(_TABLE).fetchall()
        self.held = 0

    def upsert(self, batch: pa.RecordBatch, weight: int) -> None:
        self.db.register("batch", pa.Table.from_batches([batch]))
        self.db.execute(_UPSERT).fetchall()
        self.db.unregister("batch")
        self.held += weight

    def export(self, query: str) -> Iterator[pa.RecordBatch]:
        """The result of a query, without the types of strings that differ between writers; the bucket is closed then."""
        for found in self.db.sql(query).to_arrow_reader(10_000):
            yield pa.RecordBatch.from_arrays([found.column(f.name).cast(f.type) for f in _ARROW], schema=_ARROW)
        self.db.close()


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Parts of a batch that take about HELD bytes at most once their ranges are read, and what they take."""
    import numpy as np

    width = (batch.column("hi").to_numpy() - batch.column("lo").to_numpy() + 1) % BLOCK + 1
    each = width * (ROW + batch.nbytes // max(batch.num_rows, 1))
    share = np.cumsum(each) // HELD
    edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a), int(each[a:b].sum())


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The latest change of each key among a task's rows, tombstones included."""
    held = None
    for batch in batches:
        for part, weight in _slices(batch):
            held = held or _Bucket()
            held.upsert(part, weight)
            if held.held >= HELD:
                yield from held.export(_PARTIAL)
                held = None
    if held:
        yield from held.export(_PARTIAL)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: each bucket's state, when its last row is in."""
    import numpy as np

    held, now = None, None

    def done() -> Iterator[pa.RecordBatch]:
        for out in held.export(_FINAL):
            yield pa.RecordBatch.from_arrays([pa.array([now] * out.num_rows, pa.int64()), *out.columns], names=["bucket", *out.schema.names])

    for batch in batches:
        ids = batch.column("bucket").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if held and now != ids[a]:
                yield from done()
                held = None
            held, now = held or _Bucket(), int(ids[a])
            for part, weight in _slices(batch.slice(a, b - a)):
                held.upsert(part, weight)
    if held:
        yield from done()


def apply_changes(changes: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """bucket and the latest change of each range of keys (k, lo to hi), tombstones (null v) included.

    changes: k string, lo, hi bigint (the keys, from 0 on, all within one block), t, tie
    bigint, ev string, step tinyint (the sequence, compared in this order; none may be
    null), v string (null: delete).  Changes of one sequence and key are repeats; of those
    that differ in v the greatest counts, null lowest.  previous: the result for earlier changes.
    """
    spark = changes.sparkSession
    columns = [f.name for f in _ARROW]
    partial = changes.withColumn("step", F.col("step").cast("tinyint")).select(columns).mapInArrow(_combine, CHANGE)
    partial = cut(partial if previous is None else partial.unionByName(previous.select(columns)))
    texts = F.coalesce(F.octet_length("k"), F.lit(0)) + F.coalesce(F.octet_length("ev"), F.lit(0)) + F.coalesce(F.octet_length("v"), F.lit(0))
    numbers = F.when(F.col("hi") - F.col("lo") + 1 == BLOCK, F.lit(1)).otherwise(F.col("hi") - F.col("lo") + 1)
    size = partial.agg(F.sum(numbers * (texts + ROW)).alias("n")).first().n or 0
    width = shuffle_width(spark)
    buckets = max(width, -(-size // HELD))
    placed = partial.withColumn("bucket", F.pmod(F.xxhash64("k", F.floor(F.col("lo") / BLOCK)), F.lit(buckets)))
    return placed.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_apply, f"bucket bigint, {CHANGE}")


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _claim(spark: SparkSession, file: str, text: str) -> bool:
    """Create a file of this text unless it exists; of several writers one gets it."""
    fs, path = _fs(spark, file)
    jvm = spark.sparkContext._jvm
    if fs.getUri().getScheme() == "file":  # Hadoop's local files look first and write then
        nio = jvm.java.nio.file
        at = nio.Path.of(path(file).toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
        options = spark.sparkContext._gateway.new_array(nio.OpenOption, 2)
        options[0], options[1] = nio.StandardOpenOption.CREATE_NEW, nio.StandardOpenOption.WRITE
        make = lambda: nio.Files.write(at, bytearray(text.encode()), options)
    else:

        def make() -> None:
            out = fs.create(path(file), False)
            out.write(bytearray(text.encode()))
            out.close()

    try:
        make()
        return True
    except Py4JJavaError as x:
        if "AlreadyExists" in x.java_exception.getClass().getName():
            return False
        raise


def publish(state: DataFrame, folder: str, version: int | None = None) -> str | None:
    """Write state and make it the folder's next version, whole or not at all; the path of its rows.

    Spark's commit keeps the files of one successful attempt of each task.  They become
    visible by a file of the version's number, which is created only if there is none yet
    and names where the rows are.  With a version given, only that one is tried: None if
    another writer has it.
    """
    spark = state.sparkSession
    rows = f"rows-{uuid.uuid4().hex}"
    state.write.parquet(f"{folder}/{rows}")
    for _ in range(TRIES):
        number = version or (_numbers(spark, folder) or [0])[-1] + 1
        if _claim(spark, f"{folder}/v{number:012d}", f"{rows}\n"):
            return f"{folder}/{rows}"
        if version:
            fs, path = _fs(spark, folder)
            fs.delete(path(f"{folder}/{rows}"), True)
            return None
    raise RuntimeError(f"{TRIES} other writers published to {folder} meanwhile")


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """All numbers that writers have taken, ascending."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path(folder)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(folder))]
    return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())


def _rows_of(spark: SparkSession, folder: str, number: int) -> str | None:
    """Where a version's rows are; None while its writer isn't through, or if it never came through."""
    fs, path = _fs(spark, folder)
    stream = fs.open(path(f"{folder}/v{number:012d}"))
    text = bytes(stream.readAllBytes()).decode()
    stream.close()
    return f"{folder}/{text.strip()}" if text.endswith("\n") else None


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The published versions of a folder, ascending."""
    return [n for n in _numbers(spark, folder) if _rows_of(spark, folder, n)]


def published(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version, or of the latest; None if there is none."""
    for n in [version] if version else reversed(_numbers(spark, folder)):
        if rows := _rows_of(spark, folder, n):
            return spark.read.parquet(rows)
    return None


def apply_feed(changes: DataFrame, folder: str) -> DataFrame:
    """Work changes into the folder's latest version and publish the result; its rows."""
    spark = changes.sparkSession
    for _ in range(TRIES):
        last = (_numbers(spark, folder) or [0])[-1]
        at = publish(apply_changes(changes, published(spark, folder)), folder, last + 1)
        if at:
            return spark.read.parquet(at)
    raise RuntimeError(f"{TRIES} other writers published to {folder} meanwhile")


def instant(ts: Column) -> Column:
    """Microseconds of an ISO 8601 time with zone; null if it can't be read."""
    return F.unix_micros(F.try_to_timestamp(strip(ts)))


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with lo and hi, divided at multiples of BLOCK."""
    many = 1 << 16  # blocks in a row on the way, so no array is longer
    first, last = F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK)
    rest = [c for c in rows.columns if c not in ("lo", "hi")]
    wide = rows.select(*rest, "lo", "hi", F.explode(F.sequence(first, last, F.lit(many).cast("bigint"))).alias("_b"))
    each = wide.select(*rest, "lo", "hi", F.explode(F.sequence("_b", F.least(F.col("_b") + many - 1, last))).alias("_b"))
    return each.select(*rest, F.greatest("lo", F.col("_b") * BLOCK).alias("lo"), F.least("hi", F.col("_b") * BLOCK + BLOCK - 1).alias("hi"))


def assignment_changes(events: DataFrame, widest: int | None = None) -> DataFrame:
    """Assignment events as changes of (store, chunk).

    removed is freed first (step 0), then chunks is assigned or freed (step 1).  An event
    of which a chunk list, the time or the action can't be read has no effect at all; so
    has one without store, and with widest one that has a wider range.  A null tie_no
    counts as 0; deliveries of one event are one event, as they carry one sequence.
    Chunks assigned to no user (null) become free.
    """
    action = F.lower(strip(events["action"]))
    part = lambda c, step: F.transform(ranges(events[c], widest), lambda r: F.struct(F.lit(step).cast("tinyint").alias("step"), r["lo"].alias("lo"), r["hi"].alias("hi")))
    steps = events.where(events["store_id"].isNotNull()).select(
        events["store_id"].alias("k"),
        instant(events["ts"]).alias("t"),
        F.coalesce(events["tie_no"], F.lit(0)).cast("bigint").alias("tie"),
        F.coalesce(events["event_id"], F.lit("")).alias("ev"),
        F.when(action == "assign", events["user_id"]).alias("v"),
        # a list that can't be read is null, and so is all of this: no rows
        F.explode(F.when(action.isin("assign", "unassign"), F.concat(part("removed", 0), part("chunks", 1)))).alias("r"),
    )
    return in_blocks(steps.where("t IS NOT NULL").select("k", "r.lo", "r.hi", "t", "tie", "ev", "r.step", F.when(F.col("r.step") == 1, F.col("v")).alias("v")))


def assigned_ranges(events: DataFrame, folder: str, widest: int | None = None) -> DataFrame:
    """store_id, lo, hi, user_id of the chunks that are assigned after the folder's earlier events and these."""
    live = apply_feed(assignment_changes(events, widest), folder).where("v IS NOT NULL")
    return live.select(F.col("k").alias("store_id"), "lo", "hi", F.col("v").alias("user_id"))


def assigned_chunks(events: DataFrame, folder: str, widest: int | None = WIDEST) -> DataFrame:
    """store_id, chunk, user_id of the chunks that are assigned at the end, as published.

    widest: the limit of the label store's input form; with None any range counts.
    """
    live = assigned_ranges(events, folder, widest)
    return live.select("store_id", F.explode(F.sequence("lo", "hi")).alias("chunk"), "user_id")
