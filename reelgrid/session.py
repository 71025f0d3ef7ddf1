"""Session helpers: the shared folder for cut lineage, tables by name, sizing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where none is named, local sessions (tests) get a folder on this machine; on a cluster,
    whose executors wouldn't see it, this is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="reelgrid-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Folders that each application has made in its shared folder.
_made: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which tidy deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder once and continue from the written copy."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def tidy(spark: SparkSession) -> int:
    """Delete what this application made in the shared folder; results that still read it can't be computed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = map(jvm.org.apache.hadoop.fs.Path, _made.pop(spark.sparkContext.applicationId, []))
    return sum(p.getFileSystem(conf).delete(p, True) for p in paths)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
