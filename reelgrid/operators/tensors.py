"""Exported attention and probability tensors in long form: tok, layer, bucket, v."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def long_form(vectors: DataFrame, layers: int, id: str = "vec_id", values: str = "embedding") -> DataFrame:
    """tok, layer, bucket, v (absolute values) of arrays that hold layers of equally many buckets."""
    each = vectors.select(F.col(id).alias("tok"), F.size(values).alias("n"), F.posexplode(values).alias("i", "v"))
    width = F.floor(F.col("n") / layers).cast("int")
    return each.select("tok", F.floor(F.col("i") / width).cast("int").alias("layer"), F.pmod("i", width).alias("bucket"), F.abs(F.col("v").cast("double")).alias("v"))


def bucket_ratio(vectors: DataFrame, layers: int, id: str = "vec_id", values: str = "embedding") -> DataFrame:
    """tok, bucket, ratio: a token's share of a bucket, averaged over the last quarter of layers, against the mean of all tokens.

    vectors as for long_form.  Shares are worked out within each token's array; only their means by bucket are shuffled.
    """
    rows = vectors.select(F.col(id).alias("tok"), F.transform(values, lambda x: F.abs(x.cast("double"))).alias("v"), F.floor(F.size(values) / layers).cast("int").alias("w"))
    last = max(1, layers // 4)
    starts = [F.lit(k) * F.col("w") for k in range(layers - last, layers)]
    sums = rows.select("tok", "v", "w", F.array(*[F.aggregate(F.slice("v", s + 1, F.col("w")), F.lit(0.0), lambda a, x: a + x) for s in starts]).alias("every"))
    mean = lambda b: sum((F.get("v", s + b) / (F.col("every")[i] + 1e-12) for i, s in enumerate(starts)), F.lit(0.0)) / last
    share = sums.where("w > 0").select("tok", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("w") - 1), mean)).alias("bucket", "share"))
    base = share.groupBy("bucket").agg(F.avg("share").alias("base"))
    return share.join(base, "bucket").select("tok", "bucket", F.round(F.col("share") / (F.col("base") + 1e-12), 4).alias("ratio"))


def group_means(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, bucket, mean of v over the tokens of a group (groups: tok, grp)."""
    return cells.join(groups, "tok").groupBy("grp", "bucket").agg(F.avg("v").alias("mean"))


def sink_mask(cells: DataFrame, share: float = 0.2) -> DataFrame:
    """layer, bucket, is_sink: buckets that hold more than a share of their layer's sum at the first token."""
    first = cells.agg(F.min("tok").alias("tok"))
    rows = cells.join(F.broadcast(first), "tok")
    return rows.select("layer", "bucket", (F.col("v") > share * F.sum("v").over(Window.partitionBy("layer"))).alias("is_sink"))


def sink_summary(mask: DataFrame) -> DataFrame:
    """layer, n_sinks, n_buckets."""
    return mask.groupBy("layer").agg(F.count_if("is_sink").alias("n_sinks"), F.count(F.lit(1)).alias("n_buckets"))


def margins(vectors: DataFrame, by: str, values: str = "embedding", close: float = 0.1) -> DataFrame:
    """by: least and mean lead of the greatest value over the second, how many are close, and n."""
    top = F.sort_array(F.transform(values, lambda x: F.abs(x.cast("double"))), asc=False)
    lead = vectors.where(F.size(values) >= 2).select(by, (top[0] - top[1]).alias("lead"))
    return lead.groupBy(by).agg(F.min("lead").alias("margin_min"), F.avg("lead").alias("margin_mean"), F.count_if(F.col("lead") < close).alias("n_close"), F.count(F.lit(1)).alias("n"))


def runs_of(cells: DataFrame, keep, by: str, pos: str) -> DataFrame:
    """by, run, n: consecutive positions that fit, numbered from 0 (bucket ids of token runs)."""
    kept = cells.where(keep).select(by, pos).withColumn("_g", F.col(pos) - F.row_number().over(Window.partitionBy(by).orderBy(pos)))
    runs = kept.groupBy(by, "_g").agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    return runs.select(by, (F.row_number().over(Window.partitionBy(by).orderBy("first")) - 1).alias("run"), "n", "first")


def token_regions(tokens: DataFrame, regions: DataFrame) -> DataFrame:
    """doc, name, tok: the tokens (doc, pos, text) that overlap each region of a text (doc, name, start, end: characters from 0, end not in it).

    A token's place follows from the lengths of those before it; a text and its regions are
    joined by doc, and lie in one row's reach of each other.
    """
    upto = F.sum(F.length("text")).over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    placed = tokens.select("doc", F.col("pos").alias("tok"), (upto - F.length("text")).alias("_from"), upto.alias("_to"))
    return placed.join(regions, "doc").where("_from < end AND _to > start AND start < end").select("doc", "name", "tok")


def write_cells(cells: DataFrame, folder: str) -> None:
    """Keep tensors in long form, a folder for each layer, so that reading some layers reads no others."""
    cells.repartition("layer").sortWithinPartitions("layer", "tok", "bucket").write.mode("overwrite").partitionBy("layer").parquet(folder)


def read_cells(spark: SparkSession, folder: str, layers: Sequence[int] = ()) -> DataFrame:
    """tok, layer, bucket, v as they were kept, of some layers or all."""
    cells = spark.read.parquet(folder).select("tok", "layer", "bucket", "v")
    return cells.where(F.col("layer").isin(*layers)) if layers else cells
