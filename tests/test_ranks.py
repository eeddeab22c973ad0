"""Ranks over rows that Spark cuts into ranges anew each time it makes them."""

from pyspark.sql import functions as F

from intelweave.operators import learn


def test_ranks_hold_when_rows_come_in_another_order_each_time(spark):
    """Ranges come of a sample of rows, which depends on their order."""
    n = 60_000
    rows = spark.range(n, numPartitions=8).select("id", (F.col("id") % 3).cast("string").alias("label")).repartition(8, F.rand())
    got = learn.ranked_in_groups(rows, "label", [learn.hash_order("id", 42), F.col("id")], "k", "n")
    ranks = got.groupBy("label").agg(F.count_distinct("k").alias("d"), F.max("k").alias("most"), F.min("k").alias("least"))
    assert sorted(map(tuple, ranks.collect())) == [(x, n // 3, n // 3, 1) for x in "012"]
    split = learn.random_split(rows.select("id"), "id").groupBy("split").count()
    assert {r["split"]: r["count"] for r in split.collect()} == {"train": 42_000, "val": 9_000, "test": 9_000}
