"""Neighbourhood aggregation and readout. features: (report_id, node_idx, x array of doubles); edges: (report_id, src, dst)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import by_key, kept

_NODE = ["report_id", "node_idx"]


def _sent(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Each edge with the vector of its source, at its target."""
    sources = features.select("report_id", F.col("node_idx").alias("src"), "x")
    return edges.select("report_id", "src", "dst").join(by_key(sources), ["report_id", "src"]).withColumnRenamed("dst", "node_idx")


def _width(features: DataFrame) -> int:
    """Numbers in a vector; a look at one row."""
    first = features.filter("x is not null").select(F.size("x").alias("n")).head()
    return first.n if first else 0


def _mean(df: DataFrame, keys: list[str], width: int, name: str = "v") -> DataFrame:
    """Means of the vectors, a column for each place: rows are added up by hash before they are dealt out, which vectors as objects are not."""
    means = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[k]).alias(f"__{k}") for k in range(width)])
    return means.select(*keys, F.array(*[F.col(f"__{k}") for k in range(width)]).cast("array<double>").alias(name), "n")


def _or_zeros(v, x):
    return F.coalesce(v, F.transform(x, lambda _: F.lit(0.0)))


def mean_aggregate(edges: DataFrame, features: DataFrame, rounds: int = 1, parts: int | None = None) -> DataFrame:
    """Own vector followed by the mean of the neighbours', round after round; zeros without neighbours.

    Each round reads features twice: before a further round they become a table, so that its plan is as large as the first's.
    parts are those of kept tables of edges and features.
    """
    for k in range(rounds):
        features = kept(features, parts) if k else features
        near = _mean(_sent(edges, features), _NODE, _width(features))
        features = features.join(by_key(near), _NODE, "left").select(*_NODE, F.concat("x", _or_zeros(F.col("v"), F.col("x"))).alias("x"))
    return features


def gcn_aggregate(edges: DataFrame, features: DataFrame, rounds: int = 1, parts: int | None = None) -> DataFrame:
    """Sum over neighbours and the node itself of x / sqrt(d_i d_j); d counts incoming edges and the added loop.

    With more rounds than one, the degrees and each round's features are tables, and plans stay of one size. parts as in mean_aggregate.
    """
    plain = edges.filter("src <> dst").select("report_id", "src", "dst")
    loops = features.select("report_id", F.col("node_idx").alias("src"), F.col("node_idx").alias("dst"))
    every = plain.unionByName(loops)
    every = every if parts is None else kept(every, parts)
    degree = every.groupBy("report_id", F.col("dst").alias("node_idx")).agg(F.count(F.lit(1)).alias("d"))
    degree = kept(degree, parts) if rounds > 1 else degree
    for k in range(rounds):
        features = kept(features, parts) if k else features
        scaled = features.join(by_key(degree), _NODE).select(*_NODE, F.transform("x", lambda v: v / F.sqrt("d")).alias("x"))
        near = _mean(_sent(every, scaled), _NODE, _width(features))
        features = near.join(by_key(degree), _NODE).select(*_NODE, F.transform("v", lambda v: v * F.col("n") / F.sqrt("d")).alias("x"))
    return features


def sum_aggregate(edges: DataFrame, features: DataFrame, eps: float = 0.0) -> DataFrame:
    """(1 + eps) x plus the sum of the neighbours'."""
    near = _mean(_sent(edges, features), _NODE, _width(features))
    total = F.zip_with("x", _or_zeros(F.col("v"), F.col("x")), lambda a, b: (1 + eps) * a + b * F.coalesce("n", F.lit(0)))
    return features.join(by_key(near), _NODE, "left").select(*_NODE, total.alias("x"))


def relation_aggregate(edges: DataFrame, features: DataFrame) -> DataFrame:
    """(report_id, node_idx, relation, v): mean of the neighbours' by relation; edges carry relation."""
    sources = features.select("report_id", F.col("node_idx").alias("src"), "x")
    sent = edges.join(by_key(sources), ["report_id", "src"]).withColumnRenamed("dst", "node_idx")
    return _mean(sent, [*_NODE, "relation"], _width(features)).drop("n")


def pool(features: DataFrame) -> DataFrame:
    """(report_id, mean, max) over the nodes."""
    x = array_to_vector(F.col("x"))
    return features.groupBy("report_id").agg(vector_to_array(Summarizer.mean(x)).alias("mean"), vector_to_array(Summarizer.max(x)).alias("max"))


def attention_weights(scores: DataFrame) -> DataFrame:
    """scores (report_id, node_idx, score) with weight: softmax over the report."""
    own = W.partitionBy("report_id")
    e = scores.withColumn("e", F.exp(F.col("score") - F.max("score").over(own)))
    return e.select(*_NODE, (F.col("e") / F.sum("e").over(own)).alias("weight"))


def pool_attention(features: DataFrame, scores: DataFrame) -> DataFrame:
    """(report_id, att): sum of x weighted by the softmax of the scores."""
    both = features.join(by_key(attention_weights(scores)), _NODE)
    mean = both.groupBy("report_id").agg(vector_to_array(Summarizer.mean(array_to_vector(F.transform("x", lambda v: v * F.col("weight"))))).alias("v"), F.count(F.lit(1)).alias("n"))
    return mean.select("report_id", F.transform("v", lambda v: v * F.col("n")).alias("att"))


def gated_fusion(a, b, gate):
    """gate a + (1 - gate) b for array columns and a gate column."""
    return F.zip_with(a, b, lambda x, y: gate * x + (1 - gate) * y)


def concat_readout(pooled: DataFrame, attention: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(report_id, readout): mean, max and attention pools, then the report's own vector (report_id, v) if given."""
    out = pooled.join(by_key(attention), "report_id").select("report_id", F.concat("mean", "max", "att").alias("readout"))
    return out if vectors is None else out.join(vectors, "report_id", "left").select("report_id", F.concat("readout", F.coalesce("v", F.array().cast("array<double>"))).alias("readout"))
