"""Runs, configurations, fingerprints, indexes and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(text: Column, digits: int = 10) -> Column:
    """The head of a text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, digits)


def index_fingerprint(listing: DataFrame, by: Sequence[str], changed: str) -> DataFrame:
    """Number of entries and last change, which tell whether an index is still valid."""
    return listing.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(changed).alias("last"))


def index_last_wins(entries: DataFrame, keys: Sequence[str], number: Sequence[str], value: str) -> DataFrame:
    """Of each key the value of the highest number."""
    return entries.groupBy(*keys).agg(F.max_by(value, F.struct(*number)).alias(value))


def by_priority(entries: DataFrame, keys: Sequence[str], source: str, order: Sequence[str], tie: str, value: str) -> DataFrame:
    """Of each key the value from the source that comes first in order (others last), of these the least tie."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.coalesce(source, F.lit(""))), F.lit(0)), F.lit(len(order) + 1))
    return entries.groupBy(*keys).agg(F.min_by(value, F.struct(rank.alias("r"), F.col(tie))).alias(value))


def config_diff(old: Column, new: Column, ignore: Sequence[str] = ()) -> Column:
    """array<struct<key, old, new, state>>: changed values; unverified where the old one is missing or null."""
    keys = F.array_except(F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new))), F.array(*map(F.lit, ignore)).cast("array<string>"))
    each = F.transform(keys, lambda k: F.struct(k.alias("key"), F.try_element_at(old, k).alias("old"), F.try_element_at(new, k).alias("new")))
    marked = F.transform(each, lambda e: F.struct(e["key"].alias("key"), e["old"].alias("old"), e["new"].alias("new"), F.when(e["old"].isNull(), "unverified").otherwise("changed").alias("state")))
    return F.filter(marked, lambda e: ~e["old"].eqNullSafe(e["new"]))


#: fixed values: marks of a failed shard in its log
ERROR_MARKS = ("Traceback (most recent call last)", "[error]", "CUDA out of memory")


def log_errors(lines: DataFrame, marks: Sequence[str] = ERROR_MARKS) -> DataFrame:
    """file, detail of logs (file, pos, line) with an error mark: the last line at the margin after the last
    traceback began, else the last line with the first mark that occurs."""
    rows = lines.where(F.trim("line") != "")
    start = F.max(F.when(F.col("line").startswith(marks[0]), F.col("pos"))).over(Window.partitionBy("file"))
    rows = rows.withColumn("_from", start)
    margin = ~F.col("line").rlike(r"^(  |\t)")
    per = rows.groupBy("file").agg(
        F.max_by("line", F.when((F.col("pos") >= F.col("_from")) & margin, F.col("pos"))).alias("after"),
        *[F.max_by("line", F.when(F.contains("line", F.lit(m)), F.col("pos"))).alias(f"m{i}") for i, m in enumerate(marks)],
    )
    found = [F.col(f"m{i}") for i in range(len(marks))]
    return per.select("file", F.coalesce("after", *found).alias("detail")).where("detail IS NOT NULL")


def latest(runs: DataFrame, path: str, changed: str) -> DataFrame:
    """The path of the newest run; of equally new ones the first by name."""
    return runs.agg(F.max_by(path, F.struct(F.col(changed))).alias(path))


def log_progress(lines: DataFrame, pattern: str = r"(\d+)\s*/\s*(\d+)") -> DataFrame:
    """file, done, total, tail: how far each log (file, pos, line) says its job is, by the last line that says so, and its last line that isn't blank."""
    said = F.when(F.col("line").rlike(pattern), F.struct(F.regexp_extract("line", pattern, 1).try_cast("bigint").alias("done"), F.regexp_extract("line", pattern, 2).try_cast("bigint").alias("total")))
    per = lines.where(F.trim("line") != "").groupBy("file").agg(F.max_by(said, F.when(said.isNotNull(), F.col("pos"))).alias("r"), F.max_by("line", "pos").alias("tail"))
    return per.select("file", "r.done", "r.total", "tail")
