"""The contexts of a hot anchor go to all tasks, those that are merged to one."""

from pyspark.sql import functions as F

from peakloom.llm import suffix_dedup


def test_hot_contexts_are_spread(spark):
    # small partitions would be coalesced
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def spread(spark):
    rows = [(h, c * 7919, 0, h == 1, b"x" * 263) for h in (1, 2, 3) for c in range(400)]
    contents = spark.createDataFrame(rows, "h bigint, c bigint, off bigint, hot boolean, ctx binary")
    out = suffix_dedup.dealt(contents).withColumn("task", F.spark_partition_id()).groupBy("h").agg(F.count_distinct("task").alias("tasks"), F.count("c").alias("n"))
    tasks = {r.h: r.tasks for r in out.collect() if r.n == 400}
    assert tasks[1] == 4 and tasks[2] == tasks[3] == 1
