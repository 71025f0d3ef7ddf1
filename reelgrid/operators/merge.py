"""One row of each key out of many: keep first, best or last, resume and overlap reports.

All three are aggregates of the form min_by/max_by, so rows are combined within each task
before anything is shuffled, and a key with very many rows costs one row a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], by) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    picked = df.groupBy(*keys).agg(by(row, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the row that is first in order (nulls first)."""
    return _pick(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the row that is last in order (nulls first)."""
    return _pick(df, keys, order, F.max_by)


def keep_best(df: DataFrame, keys: Sequence[str], good: Column, order: Sequence[Column]) -> DataFrame:
    """Of each key the first good row, or the first if none is good."""
    return _pick(df, keys, [~F.coalesce(good, F.lit(False)), *order], F.min_by)


def done(df: DataFrame) -> Column:
    """Whether a result row is of a finished clip: it has a key and frames."""
    return (F.trim(F.coalesce(df["uuid"], F.lit(""))) != "") & (F.coalesce(df["n_frames"].try_cast("double").try_cast("int"), F.lit(0)) > 0)


def resume_scan(df: DataFrame, file: Sequence[str], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """For each file: its rows, those kept (the first finished row of a key over all files),
    those dropped (not finished) and those finished before (dup)."""
    marked = df.withColumn("_done", done(df)).withColumn("_at", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    firsts = marked.where("_done").groupBy(*keys).agg(F.min("_at").alias("_first"))
    joined = marked.join(firsts, list(keys), "left")
    kept = F.col("_done") & F.col("_at").eqNullSafe(F.col("_first"))
    return joined.groupBy(*file).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(kept).alias("keep"), F.count_if(~F.col("_done")).alias("drop"), F.count_if(F.col("_done") & ~kept).alias("dup"))


def overlap(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """For each group: rows, keys, and rows beyond the first of their key."""
    per = df.groupBy(*by, *[k for k in keys if k not in by]).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("n") - 1).alias("n_duplicates"))


def allowed(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows whose uuid is in a list (uuid, pos), with pos, the place in the list where it stands first."""
    first = wanted.where("uuid IS NOT NULL").groupBy("uuid").agg(F.min("pos").alias("pos"))
    return rows.join(first, "uuid")


def in_dataset_order(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """rows with pos of their uuid in the data set (uuid, pos); those it doesn't have come last, at its size, and rank orders them all."""
    known = positions.groupBy("uuid").agg(F.min("pos").alias("pos"))
    n = positions.agg(F.count_distinct("uuid")).first()[0]
    return rows.join(known, "uuid", "left").withColumn("pos", F.coalesce("pos", F.lit(n)))


def upsert_config(runs: DataFrame, starts: DataFrame) -> DataFrame:
    """run_id, key, at, resumes: run configurations (the same columns) after starts (run_id, key map, at), at most one of a run.

    A run that is known keeps its configuration and gets at among its resumes, if its key is
    the same; one with another key stays as it is (config_diff says how they differ).
    """
    s = starts.select("run_id", F.col("key").alias("_key"), F.col("at").alias("_at"))
    both = runs.join(s, "run_id", "full_outer")
    entries = lambda m: F.array_sort(F.map_entries(m))
    again = F.col("key").isNotNull() & entries("key").eqNullSafe(entries("_key"))
    none = F.array().cast(runs.schema["resumes"].dataType)
    resumes = F.concat(F.coalesce("resumes", none), F.when(again, F.array("_at")).otherwise(none))
    return both.select("run_id", F.coalesce("key", "_key").alias("key"), F.coalesce("at", "_at").alias("at"), resumes.alias("resumes"))


def complete(frames: DataFrame, by: Sequence[str], ready: Column, least: int = 36) -> DataFrame:
    """by, n of the groups that have at least so many frames and all of them ready."""
    per = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(ready, F.lit(False))).alias("_ready"))
    return per.where(F.col("_ready") & (F.col("n") >= least)).drop("_ready")
