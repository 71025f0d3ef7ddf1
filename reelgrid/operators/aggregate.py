"""Distributions of scores and classes over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions.packed import split_classes
from reelgrid.operators.evaluate import AXES, Taxonomy

SCALE = range(5)


def rated(rows: DataFrame) -> DataFrame:
    """run_id, name, v of the weather axes and the tier score of each row; v is null if unrated."""
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in (*AXES, "tier_score")])
    return rows.select("run_id", F.explode(each).alias("s")).select("run_id", "s.*")


def distribution(values: DataFrame) -> DataFrame:
    """run_id, name: n rated, n_unrated, n_outside (rated off the scale), mean, population variance and deviation, exact median, least and greatest.

    Counts by value are shuffled, not values, and the median is read off the counts.
    """
    counts = values.groupBy("run_id", "name", "v").agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy("run_id", "name").orderBy("v")
    some = counts.where("v IS NOT NULL").withColumns({"upto": F.sum("k").over(order), "n": F.sum("k").over(Window.partitionBy("run_id", "name"))})
    v, k, n = F.col("v"), F.col("k"), F.col("n")
    low = F.min(F.when(F.col("upto") >= F.floor((n + 1) / 2), v))
    high = F.min(F.when(F.col("upto") >= F.floor(n / 2) + 1, v))
    mean = F.sum(v * k) / F.sum("k")
    stats = some.groupBy("run_id", "name").agg(F.sum("k").alias("n"), mean.alias("mean"), F.greatest(F.sum(v * v * k) / F.sum("k") - mean * mean, F.lit(0.0)).alias("var"), ((low + high) / 2).alias("median"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    count = lambda what, name: F.coalesce(F.sum(F.when(what, k)), F.lit(0)).alias(name)
    every = counts.groupBy("run_id", "name").agg(count(v.isNull(), "n_unrated"), count(~v.isin(*SCALE), "n_outside"))
    return every.join(stats, ["run_id", "name"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "std": F.sqrt("var")})


def score_counts(values: DataFrame, scale: range = SCALE) -> DataFrame:
    """run_id, name, v, n, share of rated, share of all; values of the scale also where none has them."""
    counts = values.groupBy("run_id", "name", "v").agg(F.count(F.lit(1)).alias("n"))
    zero = values.select("run_id", "name").distinct().select("run_id", "name", F.explode(F.array(*map(F.lit, scale))).alias("v")).withColumn("n", F.lit(0).cast("bigint"))
    full = counts.unionByName(zero).groupBy("run_id", "name", "v").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("run_id", "name")
    out = full.withColumns({"every": F.sum("n").over(w), "of_rated": F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).over(w)})
    return out.where("v IS NOT NULL").select("run_id", "name", "v", "n", F.try_divide("n", "of_rated").alias("share_rated"), F.try_divide("n", "every").alias("share_all"))


def class_frequency(rows: DataFrame, tax: Taxonomy, distinct: bool = False) -> DataFrame:
    """run_id, class_name, group_name ('' if unknown to the taxonomy), n, share_all, share_special.

    distinct: a class counts once for a row, else as often as it is written.
    """
    names = split_classes(F.col("classes"))
    each = rows.select("run_id", (F.array_distinct(names) if distinct else names).alias("cs"))
    total = each.groupBy("run_id").agg(F.count(F.lit(1)).alias("every"), F.count_if(F.size("cs") > 0).alias("special"))
    n = each.select("run_id", F.explode("cs").alias("class_name")).groupBy("run_id", "class_name").agg(F.count(F.lit(1)).alias("n"))
    zero = total.select("run_id", F.explode(F.array(*map(F.lit, tax.groups))).alias("class_name")).withColumn("n", F.lit(0).cast("bigint"))
    full = n.unionByName(zero).groupBy("run_id", "class_name").agg(F.sum("n").alias("n")).join(total, "run_id")
    return full.select("run_id", "class_name", F.coalesce(tax.group(F.col("class_name")), F.lit("")).alias("group_name"), "n", (F.col("n") / F.col("every")).alias("share_all"), F.coalesce(F.try_divide("n", "special"), F.lit(0.0)).alias("share_special"))


def classes_per_clip(rows: DataFrame, zero: bool = True) -> DataFrame:
    """run_id, n_classes, n: how many rows have so many classes."""
    out = rows.select("run_id", F.size(split_classes(F.col("classes"))).alias("n_classes")).groupBy("run_id", "n_classes").agg(F.count(F.lit(1)).alias("n"))
    return out if zero else out.where("n_classes > 0")


def cooccurring(rows: DataFrame, top: int = 10) -> DataFrame:
    """run_id, a, b, n, place of the top pairs of classes in one row; ties go to the pair met first by uuid, then by name.

    A row's pairs come from its few class names; nothing pairs rows.
    """
    names = F.array_sort(F.array_distinct(split_classes(F.col("classes"))))
    pairs = F.flatten(F.transform("cs", lambda a, i: F.transform(F.slice("cs", i + 2, F.size("cs")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    each = rows.select("run_id", "uuid", names.alias("cs")).where(F.size("cs") > 1).select("run_id", "uuid", F.explode(pairs).alias("p"))
    n = each.groupBy("run_id", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"), F.min("uuid").alias("first"))
    order = Window.partitionBy("run_id").orderBy(F.desc("n"), "first", "a", "b")
    return n.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("first")


def overview(rows: DataFrame) -> DataFrame:
    """run_id: clips, special and normal ones, failed ones, parse failures, and mean classes of special ones."""
    k = F.size(split_classes(F.col("classes")))
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(k > 0).alias("n_special"), F.count_if(k == 0).alias("n_normal"), F.count_if(F.coalesce("n_frames", F.lit(0)) <= 0).alias("n_failed"),
        F.count_if(F.coalesce("parse_ok", F.lit(0)) != 1).alias("n_unparsed"), F.avg(F.when(k > 0, k)).alias("mean_classes"),
    )
