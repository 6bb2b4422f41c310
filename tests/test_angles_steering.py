"""A short table of configurations is dealt before its rows multiply."""

from pyspark.sql import functions as F

from rangelake.operators import angles as an


def test_steering_uses_all_cores(spark):
    cfg = spark.range(40).select(F.col("id").alias("config")).coalesce(1)
    out = an.steering(cfg, 90, 10, F.lit(8))
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert out.count() == 40 * 19 * 8
