"""Row numbers over all rows, without putting all rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.session import cut


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """df with consecutive numbers from 1 in a total order.

    Rows are range-partitioned and sorted once and written; each partition's first number
    is the count of the partitions before it (as many rows as there are partitions, so
    that table is broadcast), and numbers within a partition are a window over it.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_k"))
    before = counts.select("_part", F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(before), "_part").withColumn(name, F.col("_rn") + F.col("_before")).drop("_part", "_rn", "_before")


def stride(df: DataFrame, order: Sequence[Column], shard: int, shards: int) -> DataFrame:
    """Every shards-th row from the shard-th on, in order."""
    return global_row_number(df, order, "_n").where(F.pmod(F.col("_n") - 1, F.lit(shards)) == shard).drop("_n")


def in_chunks(df: DataFrame, order: Sequence[Column], size: int = 100) -> DataFrame:
    """df with chunk_no: the first size rows have 0, the next 1, and so on."""
    return global_row_number(df, order, "_n").withColumn("chunk_no", F.floor((F.col("_n") - 1) / size).cast("bigint")).drop("_n")


def quota(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps only n rows of a group in each task before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def revisions(events: DataFrame, order: Sequence[Column]) -> DataFrame:
    """events with seq, their place among all, and rev, that among their uuid's, both from 1 in a total order."""
    placed = global_row_number(events, order, "seq")
    return placed.withColumn("rev", F.row_number().over(Window.partitionBy("uuid").orderBy("seq")))
