"""Cut tables and row numbers."""

from pyspark.sql import functions as F

from reelgrid import session
from reelgrid.operators import numbering


def test_cut_and_tidy(spark):
    df = session.cut(spark.range(10).repartition(3))
    assert df.count() == 10 and session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.tidy(spark) >= 1 and session.tidy(spark) == 0


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), F.lit(0).alias("_n"))
    out = [(r.x, r.rn) for r in numbering.global_row_number(df, [F.col("x")]).collect()]
    assert sorted(out) == [(i, i + 1) for i in range(1000)]
    assert numbering.global_row_number(df.limit(0), [F.col("x")]).count() == 0
    assert sorted(r.x for r in numbering.stride(df.select("x"), [F.col("x")], 3, 100).collect()) == list(range(3, 1000, 100))
    assert {(r.chunk_no, r.n) for r in numbering.in_chunks(df.select("x"), [F.col("x")], 300).groupBy("chunk_no").agg(F.count("*").alias("n")).collect()} == {(0, 300), (1, 300), (2, 300), (3, 100)}
