"""What goes through the driver is sized by the rows that go, not by the table they were made of."""

from pyspark.sql import functions as F

from pageloom.llm.simhash_dedup import grid_links
from pageloom.operators.skew import salted_join


def test_grid_cells_are_not_broadcast(spark, tmp_path):
    spark.range(2000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("node")).write.parquet(str(tmp_path / "prints"))
    prints = spark.read.parquet(str(tmp_path / "prints"))
    assert int(str(prints._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20
    plan = grid_links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_salted_join_sends_no_copies(spark, tmp_path):
    spark.range(3000).select(F.xxhash64("id").alias("k"), F.col("id").alias("v")).write.parquet(str(tmp_path / "right"))
    right = spark.read.parquet(str(tmp_path / "right"))
    left = spark.range(9000).select(F.xxhash64(F.col("id") % 4000).alias("k"), F.col("id").alias("n"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plans, sums = {}, set()
    try:
        for limit in ("1m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            joined = salted_join(left, right, ["k"], "left", "n")
            plans[limit] = joined._jdf.queryExecution().executedPlan().toString()
            sums.add((joined.count(), joined.agg(F.sum("v")).first()[0]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastExchange" in plans["1m"] and "explode" not in plans["1m"]
    assert "BroadcastExchange" not in plans["-1"] and "explode" in plans["-1"]
    assert sums == {(9000, sum(i % 4000 for i in range(9000) if i % 4000 < 3000))}
