"""One entity graph per report: nodes, rule-based edges, statistics.

Edge builders return (report_id, src, dst); every join has the report in its key. Node 0 is the report itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.metadata import strip
from ..session import by_key, kept

ROOT_LABEL = "REPORT"
_HASHES = ["HASH_MD5", "HASH_SHA1", "HASH_SHA256"]
_EVENTS = ["OPERATION", "CAMPAIGN"]
# Which labels are linked to which across the paragraphs of a report. Pairs of hashes follow from their order.
RULES = [
    (["MALWARE", "TOOL"], ["MITRE_TECH"]),
    (_EVENTS, ["CVE"]),
    (_HASHES, ["IP", "DOMAIN", "URL"]),
    (["EMAIL"], _HASHES),
    (["CVE"], _HASHES),
    (["IP"], ["DOMAIN"]),
    (_HASHES, _HASHES),
    (_HASHES, ["REGISTRY"]),
    (_HASHES, ["FILE_PATH"]),
    (_EVENTS, ["INDUSTRY", "COUNTRY", "CITY", "ORG"]),
    (["FILE_PATH", "REGISTRY", "PROCESS"], _HASHES),
]


def keyed(entities: DataFrame) -> DataFrame:
    return entities.withColumn("text_key", F.lower(strip(F.col("text")))).filter("text_key <> ''")


def build_nodes(entities: DataFrame, root: bool = True) -> DataFrame:
    """Distinct (text_key, label) of each report, numbered by first mention (paragraph, ordinal), with that mention's text."""
    first = keyed(entities).groupBy("report_id", "text_key", "label").agg(F.min(F.struct("paragraph_index", "ordinal", "text", "start", "end")).alias("m"))
    order = W.partitionBy("report_id").orderBy("m.paragraph_index", "m.ordinal")
    numbered = first.select("report_id", (F.row_number().over(order) - (0 if root else 1)).alias("node_idx"), "label", F.col("m.text").alias("text"), "text_key", F.col("m.paragraph_index").alias("paragraph_index"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))
    if not root:
        return numbered
    none = F.lit(None).cast("int")
    roots = first.select("report_id").distinct().select("report_id", F.lit(0).alias("node_idx"), F.lit(ROOT_LABEL).alias("label"), F.col("report_id").alias("text"), F.lower("report_id").alias("text_key"), none.alias("paragraph_index"), none.alias("start"), none.alias("end"))
    return roots.unionByName(numbered)


def entity_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("label") != ROOT_LABEL)


def min_entities_filter(nodes: DataFrame, least: int = 3) -> DataFrame:
    """The nodes of reports with at least so many entity nodes."""
    big = entity_nodes(nodes).groupBy("report_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return nodes.join(by_key(big), "report_id", "left_semi")


def mentions(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """(report_id, paragraph_index, ordinal, node_idx, label): mentions with their node; those without a node go."""
    own = entity_nodes(nodes).select("report_id", "text_key", "label", "node_idx")
    return keyed(entities).join(by_key(own), ["report_id", "text_key", "label"]).select("report_id", "paragraph_index", "ordinal", "node_idx", "label")


def _pairs(left: DataFrame, keys: list[str], condition: str = "src < dst") -> DataFrame:
    a, b = left.withColumnRenamed("node_idx", "src"), left.withColumnRenamed("node_idx", "dst")
    return a.join(by_key(b), keys).filter(condition).select("report_id", "src", "dst")


def edges_cooccurrence(found: DataFrame) -> DataFrame:
    """All pairs of nodes of one paragraph."""
    return _pairs(found.select("report_id", "paragraph_index", "node_idx").distinct(), ["report_id", "paragraph_index"]).distinct()


def edges_single_selfloop(found: DataFrame) -> DataFrame:
    """A loop at the node of a paragraph that has one node only."""
    one = found.groupBy("report_id", "paragraph_index").agg(F.min("node_idx").alias("src"), F.max("node_idx").alias("dst"))
    return one.filter("src = dst").select("report_id", "src", "dst").distinct()


def edges_cross_paragraph(found: DataFrame) -> DataFrame:
    """For each node in two paragraphs or more, all pairs of nodes of these paragraphs."""
    place = found.select("report_id", "paragraph_index", "node_idx").distinct()
    anchors = place.groupBy("report_id", "node_idx").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("report_id", F.col("node_idx").alias("anchor"))
    spots = place.withColumnRenamed("node_idx", "anchor").join(by_key(anchors), ["report_id", "anchor"])
    near = spots.join(by_key(place), ["report_id", "paragraph_index"]).select("report_id", "anchor", "node_idx").distinct()
    return _pairs(near, ["report_id", "anchor"]).distinct()


def edges_root(nodes: DataFrame) -> DataFrame:
    return entity_nodes(nodes).select("report_id", F.lit(0).alias("src"), F.col("node_idx").alias("dst"))


def rule_table(spark, rules: list | None = None) -> DataFrame:
    """(src_label, dst_label) of the type rules: a few dozen rows, data rather than code."""
    flat = sorted({(a, b) for sources, targets in (RULES if rules is None else rules) for a in sources for b in targets})
    return spark.createDataFrame(flat, T.StructType([T.StructField("src_label", T.StringType()), T.StructField("dst_label", T.StringType())]))


def edges_semantic(nodes: DataFrame, rules: list | None = None) -> DataFrame:
    """Edges between nodes whose labels a rule links. Pairs of hashes go from the earlier to the later in (label, node) order."""
    own = entity_nodes(nodes).select("report_id", "node_idx", "label")
    table = F.broadcast(rule_table(nodes.sparkSession, rules))
    src = own.select("report_id", F.col("node_idx").alias("src"), F.col("label").alias("src_label")).join(table, "src_label")
    dst = own.select("report_id", F.col("node_idx").alias("dst"), F.col("label").alias("dst_label"))
    both_hashes = F.col("src_label").isin(_HASHES) & F.col("dst_label").isin(_HASHES)
    place = lambda c: F.array_position(F.lit(_HASHES), F.col(c))
    ordered = F.struct(place("src_label"), F.col("src")) < F.struct(place("dst_label"), F.col("dst"))
    return src.join(by_key(dst), ["report_id", "dst_label"]).filter(~both_hashes | ordered).select("report_id", "src", "dst").distinct()


def edges_campaign(found: DataFrame) -> DataFrame:
    """All pairs of mentions of a paragraph that holds an operation or campaign; a repeated node gives a loop."""
    held = found.filter(F.col("label").isin(_EVENTS)).select("report_id", "paragraph_index").distinct()
    inside = found.join(by_key(held), ["report_id", "paragraph_index"], "left_semi")
    # mentions needn't be paired one by one: each pair of nodes once, in the order of their first mentions, and a loop for two mentions
    per = inside.groupBy("report_id", "paragraph_index", "node_idx").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    a = per.select("report_id", "paragraph_index", F.col("node_idx").alias("src"), F.col("first").alias("fa"))
    b = per.select("report_id", "paragraph_index", F.col("node_idx").alias("dst"), F.col("last").alias("lb"))
    return a.join(by_key(b), ["report_id", "paragraph_index"]).filter("fa < lb").select("report_id", "src", "dst").distinct()


def edges_small_graph(nodes: DataFrame, smallest: int = 2, largest: int = 4) -> DataFrame:
    """All pairs of nodes of reports with that few entity nodes."""
    own = entity_nodes(nodes).select("report_id", "node_idx")
    few = own.groupBy("report_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(smallest, largest))
    return _pairs(own.join(by_key(few), "report_id", "left_semi"), ["report_id"])


def edges_fallback(nodes: DataFrame, edges: DataFrame, root: bool = True) -> DataFrame:
    """For reports without any edge: a loop at the first node, and a link from the report to it."""
    bare = entity_nodes(nodes).join(by_key(edges.select("report_id").distinct()), "report_id", "left_anti").groupBy("report_id").agg(F.min("node_idx").alias("first"))
    loop = bare.select("report_id", F.col("first").alias("src"), F.col("first").alias("dst"))
    return loop.unionByName(bare.select("report_id", F.lit(0).alias("src"), F.col("first").alias("dst"))) if root else loop


def symmetrize(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse, in one pass."""
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select("report_id", F.inline(ways))


def assemble_edges(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def build_edges(entities: DataFrame, nodes: DataFrame, root: bool = True, undirected: bool = True, rules: list | None = None, parts: int | None = None) -> DataFrame:
    """All strategies together, distinct. nodes and entities are read by several of them: keep them as tables for large inputs.

    Where both are kept in so many parts by report, all edges of a report are made in one task and nothing is shuffled.
    """
    found = kept(mentions(entities, nodes), parts)
    ways = [edges_cooccurrence(found), edges_single_selfloop(found), edges_cross_paragraph(found), edges_semantic(nodes, rules), edges_campaign(found), edges_small_graph(nodes)]
    if root:
        ways.append(edges_root(nodes))
    edges = reduce(lambda a, b: a.unionByName(b), ways)
    if not root:  # with the report as a node, no graph is without an edge
        edges = edges.unionByName(edges_fallback(nodes, edges, root))
    # a union is not known to lie as its parts do: the table is
    edges = edges if parts is None else kept(edges, parts)
    return (symmetrize(edges) if undirected else edges).distinct()


def prune_edges(edges: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """At most so many outgoing edges of each node, those to other labels first, then by dst."""
    label = nodes.select("report_id", "node_idx", "label")
    both = edges.join(by_key(label.select("report_id", F.col("node_idx").alias("src"), F.col("label").alias("la"))), ["report_id", "src"]).join(by_key(label.select("report_id", F.col("node_idx").alias("dst"), F.col("label").alias("lb"))), ["report_id", "dst"])
    order = W.partitionBy("report_id", "src").orderBy(F.col("la") == F.col("lb"), "dst")
    return both.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).select("report_id", "src", "dst")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(report_id, max_degree, avg_degree): out-degrees with loops, over all nodes."""
    out = edges.groupBy("report_id", F.col("src").alias("node_idx")).agg(F.count(F.lit(1)).alias("d"))
    every = nodes.select("report_id", "node_idx").join(by_key(out), ["report_id", "node_idx"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    return every.groupBy("report_id").agg(F.max("d").cast("double").alias("max_degree"), F.avg("d").alias("avg_degree"))


def type_counts(nodes: DataFrame) -> DataFrame:
    """(report_id, label, n): distinct nodes of each label, the report itself left out."""
    return entity_nodes(nodes).groupBy("report_id", "label").agg(F.count(F.lit(1)).alias("n"))


def as_map(counts: DataFrame, name: str) -> DataFrame:
    """(report_id, name: map of label to n)."""
    return counts.groupBy("report_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.col("n").cast("int"))))).alias(name))


def label_mapping(reports: DataFrame) -> DataFrame:
    """(apt_group, label_idx): groups in order of code points, UNKNOWN always among them, null and empty as UNKNOWN."""
    groups = reports.select(F.coalesce(F.nullif(F.col("apt_group"), F.lit("")), F.lit("UNKNOWN")).alias("apt_group")).distinct()
    unknown = reports.sparkSession.range(1).select(F.lit("UNKNOWN").alias("apt_group"))
    # a handful of group names: one task is enough to number them
    return groups.unionByName(unknown).distinct().withColumn("label_idx", F.row_number().over(W.orderBy("apt_group")) - 1)


def graph_stats(nodes: DataFrame, edges: DataFrame, entities: DataFrame, paragraphs: DataFrame, reports: DataFrame, feature_dim: int = 225) -> DataFrame:
    """One row per graph: sizes, degrees, counts by type of nodes and of mentions, and report columns."""
    n_nodes = nodes.groupBy("report_id").agg(F.count(F.lit(1)).alias("num_nodes"))
    n_edges = edges.groupBy("report_id").agg(F.count(F.lit(1)).alias("num_edges"))
    n_paragraphs = paragraphs.groupBy("report_id").agg(F.count(F.lit(1)).alias("num_paragraphs"))
    per_label = entities.groupBy("report_id", "label").agg(F.count(F.lit(1)).alias("n"))
    n_entities = per_label.groupBy("report_id").agg(F.sum("n").alias("num_entities"))
    info = reports.select("report_id", "apt_group", "source_vendor", "published_date")
    out = n_nodes.join(by_key(n_edges), "report_id", "left").join(by_key(degrees(edges, nodes)), "report_id").join(by_key(as_map(type_counts(nodes), "type_counts")), "report_id", "left")
    out = out.join(by_key(as_map(per_label, "entity_counts")), "report_id", "left").join(by_key(n_paragraphs), "report_id", "left").join(by_key(n_entities), "report_id", "left").join(by_key(info), "report_id")
    return out.withColumn("num_edges", F.coalesce("num_edges", F.lit(0))).withColumn("feature_dim", F.lit(feature_dim))


def group_stats(stats: DataFrame) -> DataFrame:
    """Per group, and over all (apt_group null): graphs and mean sizes."""
    return stats.rollup("apt_group").agg(
        F.count(F.lit(1)).alias("num_graphs"), F.avg("num_nodes").alias("avg_num_nodes"), F.avg("num_edges").alias("avg_num_edges"), F.avg("num_entities").alias("avg_num_entities"), F.avg("feature_dim").alias("avg_feature_dim")
    )


def relation_type(src_type: Column, dst_type: Column, types: int = 40) -> Column:
    """Number of the relation between two node types."""
    return F.least(src_type * (types + 1) + dst_type, F.lit((types + 1) ** 2 - 1))
