"""Attribution results, group library and samples."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import cosine_similarity
from ..session import broadcast_if_small

#: Groups of one block, which a cluster is compared with at once.
GROUPS_HELD = 1024


def top_predictions(scores: DataFrame, k: int = 3, id_col: str = "report_id") -> DataFrame:
    """(id, top: array of (label, confidence)): the k best, ties by label."""
    every = F.array_sort(F.collect_list(F.struct((-F.col("probability")).alias("p"), "label")))
    return scores.groupBy(id_col).agg(F.transform(F.slice(every, 1, k), lambda x: F.struct(x["label"].alias("label"), (-x["p"]).alias("confidence"))).alias("top"))


def prediction_summary(predictions: DataFrame, label: str = "predicted_label") -> DataFrame:
    """(label, n, total)."""
    counts = predictions.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))


def attribution_shares(predictions: DataFrame, label: str = "predicted_label") -> DataFrame:
    """Share of each label, its rank, and the risk of the first."""
    counted = prediction_summary(predictions, label).withColumn("share", F.col("n") / F.col("total"))
    return counted.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "label"))).withColumn("risk", F.when(F.col("rank") == 1, "High")).select("label", "n", "share", "rank", "risk")


def risk_from_report(report: DataFrame) -> DataFrame:
    """classification report with risk, and top at the label of the best f1."""
    best = report.agg(F.min_by("label", F.struct(-F.col("f1"), F.col("label"))).alias("best"))
    return report.crossJoin(F.broadcast(best)).select("label", "f1", F.when(F.col("f1") > 0.8, "High").otherwise("Medium").alias("risk"), (F.col("label") == F.col("best")).alias("top"))


def confidence_band(p: Column) -> Column:
    return F.when(p > 0.8, "very high").when(p > 0.6, "high").otherwise("medium")


def cluster_band(p: Column) -> Column:
    return F.when(p > 0.7, "high").otherwise("low")


def result_listing(runs: DataFrame, name: str = "result_id") -> DataFrame:
    """result_id of the form yyyymmdd-HHMMSS_task: created and task_id; newest first, unreadable times last."""
    created = F.try_to_timestamp(F.substring_index(name, "_", 1), F.lit("yyyyMMdd-HHmmss"))
    task = F.when(F.contains(F.col(name), F.lit("_")), F.expr(f"substring({name}, instr({name}, '_') + 1)"))
    return runs.withColumn("created", created).withColumn("task_id", task).orderBy(F.desc_nulls_last("created"), name)


def similar_groups(clusters: DataFrame, groups: DataFrame, k: int = 3) -> DataFrame:
    """clusters (cluster, v) against the known groups (id, v): the k most similar of each cluster.

    The groups are packed into blocks of GROUPS_HELD, one row each; every cluster meets every block, keeps its best k
    there, and the best of these. So no row per pair is made, whatever the number of groups.
    """
    n_blocks = max(1, -(-groups.count() // GROUPS_HELD))
    dealt = groups.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"), F.struct("id", F.col("v").alias("gv")).alias("g"))
    packed = dealt.groupBy("block").agg(F.collect_list("g").alias("gs"))
    both = clusters.select("cluster", F.col("v").alias("cv"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")).join(broadcast_if_small(packed), "block")
    best = F.array_sort(F.transform("gs", lambda g: F.struct((-cosine_similarity(F.col("cv"), g["gv"])).alias("s"), g["id"].alias("id"))))
    found = both.select("cluster", F.slice(best, 1, k).alias("best")).groupBy("cluster").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return found.select("cluster", F.posexplode("best").alias("pos", "b")).select("cluster", F.col("b.id").alias("id"), (-F.col("b.s")).alias("similarity"), (F.col("pos") + 1).alias("rank"))


def cluster_centroids(points: DataFrame) -> DataFrame:
    """points (cluster, v): mean vector and size of each cluster; outliers (cluster -1) are counted but have no mean."""
    parts = points.filter("cluster <> -1").select("cluster", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))
    return points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).join(mean, "cluster", "left")


def merge_centroid(known: DataFrame, new: DataFrame) -> DataFrame:
    """known and new (id, v, n, version): count-weighted means, counts added, version up by 0.1; new ids start as v1.0."""
    k = known.select("id", F.col("v").alias("kv"), F.col("n").alias("kn"), "version")
    m = new.select("id", F.col("v").alias("nv"), F.col("n").alias("nn"))
    both = k.join(m, "id", "full")
    mean = F.zip_with("kv", "nv", lambda a, b: (a * F.col("kn") + b * F.col("nn")) / (F.col("kn") + F.col("nn")))
    bumped = F.concat(F.lit("v"), F.format_string("%.1f", F.regexp_extract("version", r"(\d+(?:\.\d+)?)", 1).cast("double") + 0.1))
    return both.select(
        "id",
        F.when(F.col("nv").isNull(), F.col("kv")).when(F.col("kv").isNull(), F.col("nv")).otherwise(mean).alias("v"),
        (F.coalesce("kn", F.lit(0)) + F.coalesce("nn", F.lit(0))).alias("n"),
        F.when(F.col("kv").isNull(), "v1.0").when(F.col("nv").isNull(), F.col("version")).otherwise(bumped).alias("version"),
    )


def cluster_reports(vectors: DataFrame, k: int = 8, method: str = "kmeans", outlier_share: float = 0.02, seed: int = 42, id_col: str = "report_id") -> DataFrame:
    """(id, cluster, distance): k-means or bisecting k-means; the farthest outlier_share of a cluster become cluster -1."""
    data = vectors.select(id_col, array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features"), "v")
    model = (BisectingKMeans if method == "hierarchical" else KMeans)(k=k, seed=seed, maxIter=20).fit(data)
    spark = vectors.sparkSession
    centers = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, c array<double>")
    placed = model.transform(data).join(F.broadcast(centers), "prediction")
    gap = F.sqrt(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    placed = placed.select(id_col, "prediction", gap.alias("distance"))
    limit = placed.groupBy("prediction").agg(F.percentile_approx("distance", 1 - outlier_share, 10_000).alias("limit"))
    return placed.join(F.broadcast(limit), "prediction").select(id_col, F.when(F.col("distance") > F.col("limit"), -1).otherwise(F.col("prediction")).alias("cluster"), "distance")


def range_select(points: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    return points.filter(F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1)))


def search_groups(groups: DataFrame, text: str = "", origin: str | None = None) -> DataFrame:
    t = text.strip().lower()
    found = groups.filter(F.contains(F.lower("id"), F.lit(t)) | F.contains(F.lower(F.coalesce("aliases", F.lit(""))), F.lit(t)))
    return found if origin is None else found.filter(F.col("origin") == origin)


def ioc_match(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """(report_id, id, label, text): entities that are an indicator of a known group."""
    known = groups.select("id", F.explode("iocs").alias("ioc")).select("id", F.lower("ioc").alias("__key")).distinct()
    return entities.withColumn("__key", F.lower("text")).join(broadcast_if_small(known), "__key").select("report_id", "id", "label", "text").distinct()


def search_samples(samples: DataFrame, text: str, columns: tuple[str, ...] = ("name", "type", "sha256", "md5")) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
    return samples.filter(hit)


def upsert_samples(known: DataFrame, new: DataFrame, key: str = "sha256", order: str = "added") -> DataFrame:
    """Union, the row added last for each key."""
    every = known.unionByName(new)
    return every.groupBy(key).agg(F.max_by(F.struct(*[c for c in every.columns if c != key]), order).alias("r")).select(key, "r.*")


def delete_reports(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("report_id").distinct(), "report_id", "left_anti")


def technique_counts(entities: DataFrame, reports: DataFrame) -> DataFrame:
    """(apt_group, technique, n): mentions of every technique by group."""
    said = entities.filter("label = 'MITRE_TECH'").select("report_id", F.upper("text").alias("technique")).join(reports.select("report_id", "apt_group"), "report_id")
    return said.groupBy("apt_group", "technique").agg(F.count(F.lit(1)).alias("n"))


def technique_matrix(entities: DataFrame, reports: DataFrame, techniques: list[str]) -> DataFrame:
    """Mentions of the named techniques by group, a column per technique. technique_counts has all of them in rows."""
    return technique_counts(entities, reports).groupBy("apt_group").pivot("technique", techniques).agg(F.sum("n")).na.fill(0)
