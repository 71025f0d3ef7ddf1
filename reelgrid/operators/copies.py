"""Differences between two copies of a dataset (problem 1).

A checksum matrix locates them: field values are hashed, a key's current ones are chosen on
the hashes alone, and wide hashes of them are added up by key bucket and column.  Sums don't
depend on the order of rows, so both copies get theirs in one pass, without being joined.
Only the buckets whose sums differ are read a second time, with only the columns that differ
anywhere, and only those rows are joined by key.

Sizes: there are as many buckets as rows need to stay near `PER_BUCKET` a bucket, so that few
differences leave most buckets equal however large the copies are, at least `BUCKETS` and at
most `MOST`.  The list of unequal buckets is broadcast if it has at most `SMALL` rows
(of 4 bytes and 1 for each column: under 4 MB), else it is shuffled with the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.functions.text import key_text, strip
from reelgrid.session import cut

BUCKETS = 65_536
MOST = 1 << 24
PER_BUCKET = 256
SMALL = 200_000
_LOW = 0xFFFFFFFF


@dataclass(frozen=True)
class CopySpec:
    """How a copy is read: its key, the number that orders a key's rows, its compared fields."""

    key: Column
    version: Column
    fields: Mapping[str, Column]


def _hash(spec: CopySpec, i: int, value: Column) -> Column:
    """64 bits of hash of a field's value; null has a hash of its own."""
    return F.xxhash64(spec.key, F.lit(i), value.isNull(), F.coalesce(value.cast("string"), F.lit("")))


def _wide(*parts: Column) -> list[Column]:
    """128 bits of hash as four non-negative 32-bit numbers, whose sums can't overflow a long."""
    one, two = F.xxhash64(F.lit(0), *parts), F.xxhash64(*reversed(parts), F.lit(1))
    return [x for h in (one, two) for x in (h.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(h, 32))]


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.hash(key, F.lit(17)), F.lit(buckets)).alias("bucket")


def _order(copy: DataFrame, spec: CopySpec, h: Column) -> Column:
    """What orders a key's values of a field: the version, then the hash.

    An int version and the hash's first 31 bits are packed into one long, so that Spark
    aggregates in its hash map instead of sorting; others need a struct.
    """
    if isinstance(copy.select(spec.version.alias("v")).schema["v"].dataType, T.IntegerType):
        v = F.coalesce(spec.version, F.lit(-(2**31))).cast("bigint")
        return F.shiftleft(v, 31).bitwiseOR(F.shiftrightunsigned(h, 33))
    return F.struct(spec.version.alias("v"), h.alias("h"))


def bucket_count(*copies: DataFrame) -> int:
    """Buckets for copies of this size: a power of two."""
    rows = max(c.count() for c in copies)
    return min(MOST, max(BUCKETS, 1 << max(0, rows // PER_BUCKET - 1).bit_length()))


def checksum_matrix(copy: DataFrame, spec: CopySpec, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n, k (sum of key hashes) and f0, f1, ... (sums of field hashes), arrays of four."""
    fields = range(len(spec.fields))
    hashed = copy.select(_bucket(spec.key, buckets), spec.key.alias("key"), *[_hash(spec, i, c).alias(f"h{i}") for i, c in enumerate(spec.fields.values())], *[_order(copy, spec, _hash(spec, i, c)).alias(f"o{i}") for i, c in enumerate(spec.fields.values())])
    current = hashed.groupBy("bucket", "key").agg(*[F.max_by(f"h{i}", f"o{i}").alias(f"h{i}") for i in fields])
    sums = [F.array(*[F.sum(h) for h in _wide(F.col("key"), F.lit("key"))]).alias("k")]
    sums += [F.array(*[F.sum(h) for h in _wide(F.col(f"h{i}"))]).alias(f"f{i}") for i in fields]
    return current.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *sums)


def unequal_buckets(left: DataFrame, right: DataFrame, n_fields: int) -> DataFrame:
    """bucket, k and f0, f1, ... as booleans: whether the keys or the field differ there."""
    names = ["k", *[f"f{i}" for i in range(n_fields)]]
    a = left.select("bucket", *[F.col(c).alias(f"a_{c}") for c in ("n", *names)])
    b = right.select("bucket", *[F.col(c).alias(f"b_{c}") for c in ("n", *names)])
    both = a.join(b, "bucket", "full_outer")
    differ = {c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in names}
    keys = differ["k"] | ~F.col("a_n").eqNullSafe(F.col("b_n"))
    found = both.select("bucket", keys.alias("k"), *[differ[c].alias(c) for c in names[1:]])
    return found.where(" OR ".join(names))


def differences(left: DataFrame, right: DataFrame, left_spec: CopySpec, right_spec: CopySpec, *, left_name: str, right_name: str, buckets: int | None = None) -> DataFrame:
    """uuid, kind, field: each key that one copy lacks and each field that differs.

    Of a key's rows the one of the highest version counts; where rows of equal versions differ
    (which the data's contract excludes), of each field the value with the greatest hash, the
    same one in both passes and in every run.  A null version is the lowest.  A null key is a
    key of its own, a null value differs from every other.  Empty tables differ by all keys of
    the other.  Other columns of the copies aren't read, so their names may clash.
    """
    fields = list(left_spec.fields)
    if fields != list(right_spec.fields):
        raise ValueError("both copies need the same fields")
    buckets = buckets or bucket_count(left, right)
    matrix = cut(unequal_buckets(checksum_matrix(left, left_spec, buckets), checksum_matrix(right, right_spec, buckets), len(fields)))
    where = matrix.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.bool_or(f"f{i}"), F.lit(False)).alias(f"f{i}") for i in range(len(fields))]).first()
    read = [i for i in range(len(fields)) if where[f"f{i}"]]
    flags = matrix.select("bucket", *[F.col(f"f{i}").alias(f"u{i}") for i in read])
    flags = F.broadcast(flags) if where["n"] <= SMALL else flags

    def rows(copy: DataFrame, spec: CopySpec, side: str) -> DataFrame:
        values = {i: c for i, c in enumerate(spec.fields.values()) if i in read}
        found = copy.select(_bucket(spec.key, buckets), spec.key.alias("key"), *[c.alias(f"c{i}") for i, c in values.items()], *[_order(copy, spec, _hash(spec, i, c)).alias(f"o{i}") for i, c in values.items()]).join(flags, "bucket")
        # values of a bucket's equal columns aren't shuffled
        current = [F.max_by(F.struct(F.when(F.col(f"u{i}"), F.col(f"c{i}")).alias("c")), f"o{i}").alias(f"f{i}") for i in read]
        return found.groupBy("key").agg(F.lit(True).alias("is"), *current).select("key", F.struct("is", *[f"f{i}" for i in read]).alias(side))

    a, b = rows(left, left_spec, "a"), rows(right, right_spec, "b")
    paired = a.join(b, a["key"].eqNullSafe(b["key"]), "full_outer").select(F.when(F.col("a").isNotNull(), a["key"]).otherwise(b["key"]).alias("uuid"), "a", "b")
    one = lambda kind, field: F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    cases = [F.when(F.col("b").isNull(), one(f"only_{left_name}", "")), F.when(F.col("a").isNull(), one(f"only_{right_name}", ""))]
    cases += [F.when(both & ~F.col(f"a.f{i}.c").eqNullSafe(F.col(f"b.f{i}.c")), one("differs", fields[i])) for i in read]
    return paired.select("uuid", F.explode(F.array_compact(F.array(*cases))).alias("d")).select("uuid", "d.kind", "d.field")


def label_copy(df: DataFrame, groups: Sequence[str] = ("Dynamic object", "Driving environment")) -> CopySpec:
    """Labels as a copy: absent, null and -1 scores are one value; notes without outer space."""
    scores = {g: F.coalesce(F.try_element_at(df["group_scores"], F.lit(g)), F.lit(-1)) for g in groups}
    note = strip(F.replace(F.coalesce(df["note"], F.lit("")), F.lit("\r\n"), F.lit("\n")))
    return CopySpec(key_text(df["uuid"]), df["rev"], scores | {"note": note})


def label_differences(store: DataFrame, mirror: DataFrame, buckets: int | None = None) -> DataFrame:
    """Differences between the label store and its mirror."""
    return differences(store, mirror, label_copy(store), label_copy(mirror), left_name="store", right_name="mirror", buckets=buckets)
