"""Training rows of a small table are dealt over the tasks; a tiny one stays as it is."""
from pyspark.sql import functions as F

from tessera.operators import models as MD


def rows_by_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    spark.range(40_000, numPartitions=1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert len(rows_by_task(one)) == 1
    counts = rows_by_task(MD.spread(one))
    assert len(counts) > 1 and sum(counts) == 40_000 and max(counts) < 40_000 // len(counts) + 100
    few = one.limit(6_000)
    assert MD.spread(few) is few
    assert len(rows_by_task(MD.spread(one, rows=1_000, most=1_000))) == 40


def test_ten_fold_tests_every_row_once(spark, tmp_path):
    rows = spark.range(12_000).select(F.col("id").alias("key"), (F.col("id") % 10).cast("int").alias("fold"), F.array(F.rand(1), F.rand(2)).alias("features"))
    rows.withColumn("label", F.when(F.col("features")[0] > 0.5, "yes").otherwise("no")).write.parquet(f"{tmp_path}/rows")
    ds = spark.read.parquet(f"{tmp_path}/rows")
    pred = MD.ten_fold(ds, MD.logistic(2), ["key"])
    assert pred.select("key").distinct().count() == pred.count() == 12_000
