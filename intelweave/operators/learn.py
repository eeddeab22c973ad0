"""Dataset preparation for learning, and the attribution classifier."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import broadcast_if_small, kept


def valid_graph_filter(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, label: str = "label") -> DataFrame:
    """Graphs with a label, a node and an edge."""
    return graphs.filter(F.col(label).isNotNull()).join(nodes.select("report_id").distinct(), "report_id", "left_semi").join(edges.select("report_id").distinct(), "report_id", "left_semi")


def hash_order(id_col: str, seed: int) -> Column:
    """An order that looks random and never changes: the digest of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))


def _named(place: Column, size: Column, train: float, val: float) -> Column:
    first, second = F.floor(size * train), F.floor(size * val)
    return F.when(place <= first, "train").when(place <= first + second, "val").otherwise("test")


def stratified_split(rows: DataFrame, id_col: str, label: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """rows with split: shares of each class by hash order, the rest is test."""
    ranked = ranked_in_groups(rows, label, [hash_order(id_col, seed), F.col(id_col)], "__k", "__n")
    return ranked.withColumn("split", _named(F.col("__k"), F.col("__n"), train, val)).drop("__k", "__n")


def ranked_globally(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place from 1 in a global order, without bringing all rows to one task.

    Rows are sorted by range; the sizes of the partitions, one number each, give every partition its first place. The
    rows with their partition become a table first: made twice, rows could be cut into other ranges the second time.
    """
    key = rows.select("*", F.struct(*order).alias("__o"))
    placed = kept(key.repartitionByRange("__o").withColumn("__p", F.spark_partition_id()))
    local = placed.withColumn("__k", F.row_number().over(W.partitionBy("__p").orderBy("__o")))
    sizes = local.groupBy("__p").agg(F.max("__k").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__before"))  # one row per partition
    return local.join(F.broadcast(before), "__p").withColumn(name, F.col("__k") + F.col("__before")).drop("__p", "__k", "__before", "__o")


def ranked_in_groups(rows: DataFrame, group: str, order: list[Column], rank: str, size: str) -> DataFrame:
    """rows with their place from 1 within their group and the group's size, also where one group holds most rows.

    The global rank by (group, order) less the rows of the groups before. The groups, one row each, are joined back.
    """
    placed = ranked_globally(rows, [F.col(group), *order], "__rank")
    counts = rows.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias(size))
    starts = counts.withColumn("__start", F.sum(size).over(W.orderBy("__group")) - F.col(size))
    both = placed.join(broadcast_if_small(starts), F.col(group).eqNullSafe(F.col("__group")))
    return both.withColumn(rank, F.col("__rank") - F.col("__start")).drop("__rank", "__group", "__start")


def random_split(rows: DataFrame, id_col: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """rows with split over all rows by hash order; shares are rounded down, the rest is test."""
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    return ranked_globally(rows, [hash_order(id_col, seed), F.col(id_col)], "__rank").crossJoin(F.broadcast(n)).withColumn("split", _named(F.col("__rank"), F.col("__n"), train, val)).drop("__rank", "__n")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, weight): all rows over classes times rows of the class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    return counts.crossJoin(F.broadcast(every)).select(label, (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def oversample(rows: DataFrame, label: str) -> DataFrame:
    """Rows of each class repeated until the class is as large as the largest, rounded up; copy numbers them from 1."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    most = counts.agg(F.max("__n").alias("__most"))
    times = counts.crossJoin(F.broadcast(most)).select(F.col(label).alias("__label"), F.ceil(F.col("__most") / F.col("__n")).cast("int").alias("__times"))
    return rows.join(F.broadcast(times), F.col(label).eqNullSafe(F.col("__label"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__label", "__times")


def stratified_kfold(rows: DataFrame, id_col: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """rows with fold, from 0: each class dealt out by hash order."""
    ranked = ranked_in_groups(rows, label, [hash_order(id_col, seed), F.col(id_col)], "__k", "__n")
    return ranked.withColumn("fold", ((F.col("__k") - 1) % folds).cast("int")).drop("__k", "__n")


def edge_dropout(edges: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """edges without about share of them, chosen by digest, so the same ones each time and in any engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "report_id", "src", "dst").cast("binary"))
    return edges.filter(F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long") >= int(share * (1 << 32)))


def feature_noise(features: DataFrame, scale: float, seed: int = 42) -> DataFrame:
    """x with noise of up to scale either way, by hash of node and place."""
    jitter = lambda v, i: v + scale * (F.pmod(F.xxhash64(F.lit(seed), F.col("report_id"), F.col("node_idx"), i), F.lit(2_000_001)) / 1_000_000.0 - 1)
    return features.withColumn("x", F.transform("x", jitter))


def experiment_grid(options: dict[str, DataFrame]) -> DataFrame:
    """Every combination of the option tables (one column each, named as the key), with config, the values joined by __."""
    out = None
    for name, values in options.items():
        one = values.select(F.col(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out.withColumn("config", F.concat_ws("__", *[F.col(n).cast("string") for n in options]))


def attribution_classifier(train: DataFrame, vector: str = "readout", label: str = "apt_group", weight: str | None = None, estimator=None):
    """A fitted pipeline from report vectors to groups; any Spark ML classifier will do."""
    ready = train.withColumn("features", array_to_vector(F.col(vector)))
    kind = estimator or LogisticRegression(maxIter=20, regParam=0.01)
    kind = kind.copy().setFeaturesCol("features").setLabelCol("label_idx")
    if weight:
        kind = kind.setWeightCol(weight)
    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc", handleInvalid="keep"), kind]).fit(ready)


def fold_predictions(rows: DataFrame, id_col: str = "report_id", label: str = "apt_group", folds: int = 5, seed: int = 42, fit=None) -> DataFrame:
    """(report_id, fold, label, probability) of every row by a model that hasn't seen it: one model for each fold, fitted on the others.

    Folds are those of stratified_kfold, kept as a table. fit takes training rows and gives a model that predict takes;
    attribution_classifier with class weights of the training rows, if nothing is given. A class all of whose rows are in
    one fold has no probability there.
    """
    dealt = kept(stratified_kfold(rows, id_col, label, folds, seed))

    def weighted(train: DataFrame):
        return attribution_classifier(train.join(broadcast_if_small(class_weights(train, label)), label), label=label, weight="weight")

    parts = []
    for k in range(folds):
        model = (fit or weighted)(dealt.filter(F.col("fold") != k).drop("fold"))
        parts.append(predict(model, dealt.filter(F.col("fold") == k)).withColumn("fold", F.lit(k)))
    return reduce(DataFrame.unionByName, parts).select("report_id", "fold", "label", "probability")


def predict(model, rows: DataFrame, vector: str = "readout") -> DataFrame:
    """(report_id, label, probability): one row for each report and class."""
    labels = model.stages[0].labels
    scored = model.stages[1].transform(rows.withColumn("features", array_to_vector(F.col(vector)))).select("report_id", vector_to_array("probability").alias("p"))
    each = scored.select("report_id", F.posexplode("p").alias("k", "probability"))
    return each.withColumn("label", F.get(F.lit(labels), F.col("k"))).filter("label is not null").select("report_id", "label", "probability")
