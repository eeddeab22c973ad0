"""Neighbours' vectors are added up by hash before they are dealt out, not as objects that Spark sorts."""

from pyspark.sql import functions as F

from intelweave.operators import propagate as N


def test_means_are_hash_aggregates(spark):
    x = spark.createDataFrame([("r", 0, [1.0, 2.0]), ("r", 1, [3.0, 6.0]), ("r", 2, [5.0, 10.0])], "report_id string, node_idx int, x array<double>")
    edges = spark.createDataFrame([("r", 0, 2), ("r", 1, 2), ("r", 2, 0)], "report_id string, src int, dst int")
    rows = lambda df, *cols: sorted(tuple(map(str, r)) for r in df.select("node_idx", *cols).collect())
    total, mean, kinds = N.sum_aggregate(edges, x), N.mean_aggregate(edges, x), N.relation_aggregate(edges.withColumn("relation", F.lit(7)), x)
    for df in (total, mean, kinds, N.gcn_aggregate(edges, x)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert rows(total, "x") == [("0", "[6.0, 12.0]"), ("1", "[3.0, 6.0]"), ("2", "[9.0, 18.0]")]
    assert rows(mean, "x") == [("0", "[1.0, 2.0, 5.0, 10.0]"), ("1", "[3.0, 6.0, 0.0, 0.0]"), ("2", "[5.0, 10.0, 2.0, 4.0]")]
    assert rows(kinds, "relation", "v") == [("0", "7", "[5.0, 10.0]"), ("2", "7", "[2.0, 4.0]")]
    assert N.sum_aggregate(edges, x.limit(0)).collect() == []
