"""Classification metrics from predictions (model, label, predicted)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model").agg(F.round(F.avg((F.col("label") == F.col("predicted")).cast("double")), 6).alias("accuracy"))


def confusion(predictions: DataFrame) -> DataFrame:
    """model, actual, predicted, n with zero cells, over the labels that a model's rows show on either side."""
    labels = predictions.select("model", F.explode(F.array("label", "predicted")).alias("c")).distinct()
    grid = labels.withColumnRenamed("c", "actual").join(labels.withColumnRenamed("c", "predicted"), "model")
    counts = predictions.groupBy("model", F.col("label").alias("actual"), "predicted").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["model", "actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_report(matrix: DataFrame) -> DataFrame:
    """model, class, precision, recall, f1 (0 where undefined), support."""
    diagonal = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = matrix.groupBy("model", F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(diagonal).alias("hit"))
    columns = matrix.groupBy("model", F.col("predicted").alias("class")).agg(F.sum("n").alias("claimed"))
    both = rows.join(columns, ["model", "class"]).withColumn("precision", _ratio(F.col("hit"), F.col("claimed"))).withColumn("recall", _ratio(F.col("hit"), F.col("support")))
    return both.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("model", "class", "precision", "recall", "f1", "support")


def macro(report: DataFrame) -> DataFrame:
    return report.groupBy("model").agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))


def weighted(report: DataFrame) -> DataFrame:
    share = lambda c: _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
    return report.groupBy("model").agg(*(share(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))


def full_report(predictions: DataFrame) -> DataFrame:
    """The printed report as rows: classes, accuracy, macro avg, weighted avg; metrics rounded to 6 digits."""
    report = class_report(confusion(predictions)).withColumn("class", F.col("class").cast("string"))
    right = predictions.groupBy("model").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("f1"), F.count(F.lit(1)).alias("support"))
    rows = report.unionByName(right.select("model", F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"), "f1", "support"))
    for name, part in (("macro avg", macro(report)), ("weighted avg", weighted(report))):
        rows = rows.unionByName(part.withColumn("class", F.lit(name)))
    return rows.select("model", "class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


def model_metrics(predictions: DataFrame) -> DataFrame:
    """model, accuracy, macro precision, recall and f1, rounded to 6 digits."""
    averages = macro(class_report(confusion(predictions))).drop("support")
    return accuracy(predictions).join(averages.select("model", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1"))), "model")


def comparison(metrics: DataFrame) -> DataFrame:
    """metrics (model, kind, ord, ...) with position by accuracy, best first, the first given winning ties."""
    return metrics.withColumn("position", F.row_number().over(Window.orderBy(F.desc("accuracy"), "ord")).cast("long"))


def best_per_kind(metrics: DataFrame) -> DataFrame:
    ranked = metrics.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("accuracy"), "ord")))
    return ranked.filter("r = 1").drop("r")


def radar(metrics: DataFrame) -> DataFrame:
    """kind, model, metric, value of the best model of each kind; nothing with fewer than two kinds."""
    best = best_per_kind(metrics).withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).filter("kinds >= 2")
    return best.unpivot(["kind", "model"], ["accuracy", "precision", "recall", "f1"], "metric", "value")


def best_epoch(history: DataFrame) -> DataFrame:
    """The first epoch of the largest validation accuracy, and that accuracy."""
    return history.agg(F.min_by("epoch", F.struct(-F.col("val_accuracy"), F.col("epoch"))).alias("epoch"), F.max("val_accuracy").alias("val_accuracy"))


def training_curve(history: DataFrame) -> DataFrame:
    """epoch, val_accuracy, the best so far, and whether the epoch improved on it. An epoch is a row, so they are few."""
    so_far = Window.orderBy("epoch")
    before = F.max("val_accuracy").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    return history.select("epoch", "val_accuracy", F.max("val_accuracy").over(so_far).alias("best_so_far"), (before.isNull() | (F.col("val_accuracy") > before)).alias("improved"))
