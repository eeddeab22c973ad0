"""Joins of graph tables: no side of them is held by the driver, however small the files are."""

from pyspark.sql import functions as F

from intelweave.operators import graph as G
from intelweave.operators import propagate as N
from intelweave.plans import queries as Q
from intelweave.session import kept


def _tables(spark):
    rows = [("r1", 0, "IP", "10.1.2.3", 1), ("r1", 0, "CVE", "CVE-2021-1234", 2), ("r1", 1, "CVE", "cve-2021-1234", 1), ("r1", 1, "OPERATION", "Operation X", 2), ("r1", 1, "ORG", "Sony", 3), ("r2", 0, "IP", "10.1.2.4", 1)]
    found = spark.createDataFrame(rows, "report_id string, paragraph_index int, label string, text string, ordinal int").select("*", F.lit(0).alias("start"), F.lit(1).alias("end"))
    found = kept(found)
    nodes = kept(G.min_entities_filter(G.build_nodes(found)))
    return found, nodes


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_edges_and_statistics_broadcast_the_rules_only(spark):
    found, nodes = _tables(spark)
    edges = G.build_edges(found, nodes)
    assert _broadcasts(edges) == 1
    edges = kept(edges)
    assert set(edges.filter("src = 0").select("dst").toPandas()["dst"]) == {1, 2, 3, 4}
    paragraphs = found.select("report_id", "paragraph_index").distinct()
    reports = spark.createDataFrame([("r1", "A", "V", None)], "report_id string, apt_group string, source_vendor string, published_date date")
    stats = G.graph_stats(nodes, edges, found, paragraphs, reports)
    assert _broadcasts(stats) == 0
    assert [tuple(r) for r in stats.select("report_id", "num_nodes", "num_paragraphs", "num_entities").collect()] == [("r1", 5, 2, 5)]
    assert _broadcasts(G.prune_edges(edges, nodes, 2)) == 0 == _broadcasts(G.degrees(edges, nodes))
    x = nodes.select("report_id", "node_idx", F.array(F.lit(1.0)).alias("x"))
    assert _broadcasts(N.mean_aggregate(edges, x)) == _broadcasts(N.gcn_aggregate(edges, x)) == _broadcasts(N.sum_aggregate(edges, x)) == 0


def test_g9_takes_whole_graphs(spark, monkeypatch):
    """Nodes of every label count, so that a graph of 36 nodes is small and one of 37 is not."""
    rows = [(r, 0, "ORG", f"o{k}", k) for r, n in (("r1", 36), ("r2", 37)) for k in range(n)]
    found = spark.createDataFrame(rows, "report_id string, paragraph_index int, label string, text string, ordinal int").select("*", F.lit(0).alias("start"), F.lit(1).alias("end"))

    monkeypatch.setattr(Q.Tables, "entities", found)
    got = Q.QUERIES["g9_edges_small_graph"](spark, None)
    assert {tuple(r) for r in got.groupBy("report_id").count().collect()} == {("r1", 36 * 35 // 2)}


def test_edges_are_made_where_reports_lie(spark):
    """Tables dealt out by report: no edge is shuffled, and edges, sums and degrees are those of tables that lie anyhow."""
    from intelweave.plans import views as V
    from intelweave.session import co_partitioned

    found = V.entities(spark, "/root/testdata/sf0.001")
    plain_nodes = kept(G.min_entities_filter(G.build_nodes(kept(found))))
    dealt = kept(found.repartition(3, "report_id"), 3)
    nodes = kept(G.min_entities_filter(G.build_nodes(dealt)), 3)
    edges = kept(G.build_edges(dealt, nodes, parts=3), 3)
    want = G.build_edges(found, plain_nodes)
    assert edges.exceptAll(want).isEmpty() and want.exceptAll(edges).isEmpty()
    with co_partitioned(spark):
        for made in (G.edges_cross_paragraph(G.mentions(dealt, nodes)), G.prune_edges(edges, nodes, 8), G.degrees(edges, nodes)):
            assert "Exchange hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert G.degrees(edges, nodes).exceptAll(G.degrees(want, plain_nodes)).isEmpty()
