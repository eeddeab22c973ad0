"""Evaluation of predictions: (id, label, predicted) or class probabilities, all as columns and group sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import let


def accuracy(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return rows.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def confusion_counts(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(rows: DataFrame, classes: list, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row per true class, a column per predicted one, zeros filled in."""
    return rows.groupBy(label).pivot(predicted, classes).agg(F.count(F.lit(1))).na.fill(0)


def classification_report(rows: DataFrame, labels: DataFrame | None = None, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(label, precision, recall, f1, support) for every class; 0 where a share has no base."""
    counts = confusion_counts(rows, label, predicted)
    true = counts.groupBy(F.col(label).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)).alias("tp"))
    pred = counts.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("found"))
    every = true.join(pred, "label", "full")
    if labels is not None:
        every = every.join(labels.select("label").distinct(), "label", "full")
    share = lambda a, b: F.coalesce(F.try_divide(F.coalesce(a, F.lit(0)), b), F.lit(0.0))
    out = every.select("label", share(F.col("tp"), F.col("found")).alias("precision"), share(F.col("tp"), F.col("support")).alias("recall"), F.coalesce("support", F.lit(0)).alias("support"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def report_averages(report: DataFrame) -> DataFrame:
    """(average, precision, recall, f1, support): plain and support-weighted means over the classes."""
    n = F.sum("support")
    macro = report.agg(F.lit("macro avg").alias("average"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], n.alias("support"))
    weighted = report.agg(F.lit("weighted avg").alias("average"), *[(F.sum(F.col(c) * F.col("support")) / n).alias(c) for c in ("precision", "recall", "f1")], n.alias("support"))
    return macro.unionByName(weighted)


def balanced_accuracy(report: DataFrame) -> DataFrame:
    """Mean recall over the classes that occur."""
    return report.filter("support > 0").agg(F.avg("recall").alias("balanced_accuracy"))


def topk_accuracy(scores: DataFrame, truth: DataFrame, k: int = 3, id_col: str = "report_id") -> DataFrame:
    """scores (id, label, probability), truth (id, label): share of ids whose label is among the k best."""
    best = scores.groupBy(id_col).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("probability")).alias("p"), "label"))), 1, k).alias("best"))
    hit = F.exists("best", lambda b: b["label"] == F.col("truth"))
    return truth.select(id_col, F.col("label").alias("truth")).join(best, id_col).agg(F.avg(hit.cast("double")).alias("topk_accuracy"))


def cross_entropy(p: Column) -> Column:
    return -F.ln(p)


def focal_loss(p: Column, gamma: float = 2.0, weight: Column | None = None) -> Column:
    """-(1 - p) ** gamma ln p for the probability of the true class, times the weight of the class."""
    loss = -F.pow(1 - p, F.lit(gamma)) * F.ln(p)
    return loss if weight is None else weight * loss


def reduce_loss(rows: DataFrame, loss: Column, how: str = "mean") -> DataFrame:
    if how == "none":
        return rows.withColumn("loss", loss)
    return rows.agg((F.avg if how == "mean" else F.sum)(loss).alias("loss"))


def logit_adjust(scores: DataFrame, truth: DataFrame, tau: float = 1.0) -> DataFrame:
    """scores (id, label, logit) with logit - tau ln(share of the label in truth); labels without rows stay as they are."""
    n = truth.agg(F.count(F.lit(1)).alias("n"))
    prior = truth.groupBy("label").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(n)).select("label", (F.col("c") / F.col("n")).alias("prior"))
    return scores.join(F.broadcast(prior), "label", "left").withColumn("logit", F.col("logit") - tau * F.coalesce(F.ln("prior"), F.lit(0.0))).drop("prior")


def softmax(logits: Column) -> Column:
    e = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(e, lambda v: let(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(v, lambda x: x / total)))


def predictions(scores: DataFrame, id_col: str = "report_id") -> DataFrame:
    """(id, predicted_label, confidence) from (id, label, probability); ties go to the first label."""
    best = scores.groupBy(id_col).agg(F.min(F.struct((-F.col("probability")).alias("p"), "label")).alias("b"))
    return best.select(id_col, F.col("b.label").alias("predicted_label"), (-F.col("b.p")).alias("confidence"))


def soft_vote(scores: DataFrame, id_col: str = "report_id") -> DataFrame:
    """predictions of the mean probability over models: (model, id, label, probability)."""
    return predictions(scores.groupBy(id_col, "label").agg(F.avg("probability").alias("probability")), id_col)


def misclassified(found: DataFrame, truth: DataFrame, reports: DataFrame, stats: DataFrame) -> DataFrame:
    """found (report_id, label, probability): reports whose best label is wrong, with both confidences, file and size."""
    best = predictions(found)
    true = truth.select("report_id", F.col("label").alias("true_label"))
    own = found.select("report_id", F.col("label").alias("true_label"), F.col("probability").alias("true_confidence"))
    wrong = best.join(true, "report_id").filter("predicted_label <> true_label").join(own, ["report_id", "true_label"], "left")
    return wrong.join(reports.select("report_id", "raw_name", "file_type"), "report_id", "left").join(stats.select("report_id", "num_nodes", "num_edges"), "report_id", "left")


def label_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("No Label")).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def graph_quality_checks(graphs: DataFrame, width: int | None = None) -> DataFrame:
    """(report_id, problem) from (report_id, num_nodes, num_edges, feature_dim, has_vector)."""
    problems = F.array_compact(
        F.array(
            F.when(F.coalesce("num_nodes", F.lit(0)) == 0, "no_nodes"),
            F.when(F.coalesce("num_edges", F.lit(0)) == 0, "no_edges"),
            F.when(F.coalesce(F.col("feature_dim"), F.lit(-1)) != F.lit(width), "feature_width") if width is not None else F.lit(None).cast("string"),
            F.when(~F.coalesce("has_vector", F.lit(False)), "no_document_vector"),
        )
    )
    return graphs.select("report_id", F.explode(problems).alias("problem"))


def best_epoch(history: DataFrame) -> DataFrame:
    """The epoch of each run with the highest val_acc, then the lowest val_loss, then the first."""
    order = W.partitionBy("run_id").orderBy(F.desc("val_acc"), "val_loss", "epoch")
    return history.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def early_stop_epoch(history: DataFrame, patience: int = 25) -> DataFrame:
    """(run_id, stop_epoch): the first epoch with patience epochs since val_loss was last below all before; null if none."""
    own = W.partitionBy("run_id").orderBy("epoch")
    before = F.min("val_loss").over(own.rowsBetween(W.unboundedPreceding, -1))
    better = history.withColumn("improved", F.when(before.isNull() | (F.col("val_loss") < before), F.col("epoch")))
    last = better.withColumn("last", F.max("improved").over(own.rowsBetween(W.unboundedPreceding, 0)))
    return last.groupBy("run_id").agg(F.min(F.when(F.col("epoch") - F.col("last") >= patience, F.col("epoch"))).alias("stop_epoch"))


def summarize_grid(results: DataFrame, best: int = 5) -> DataFrame:
    """Mean metrics of each config over its runs; the best by accuracy (a top-k report)."""
    means = results.groupBy("config").agg(F.count(F.lit(1)).alias("runs"), F.avg("accuracy").alias("accuracy"), F.avg("f1_weighted").alias("f1_weighted"), F.avg("f1_macro").alias("f1_macro"))
    return means.orderBy(F.desc("accuracy"), "config").limit(best)
