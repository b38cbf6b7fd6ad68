"""Outputs: images, texts, vocabularies, features, reports, metrics and models (K1-K3, K5-K9)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.functions.image_codecs import write_png
from doclens.operators.ingest import pending


def write_images(images: DataFrame, path: str, resolution: int, done: DataFrame | None = None) -> None:
    """Processed images (class, name, ...) under resolution and class; those already in `done` (name) are left out."""
    todo = images if done is None else pending(images, done, "name", None)
    todo.withColumn("resolution", F.lit(resolution)).write.mode("append").partitionBy("resolution", "class").parquet(path)


def _png(pixels: list[int], width: int) -> bytes:
    return write_png(np.array(pixels, dtype=np.uint8).reshape(-1, width))


def write_encoded_images(images: DataFrame, path: str, encode: Callable[[list[int], int], bytes] = _png) -> None:
    """Images (class, name, pixels, width) as files' bytes, one row each: PNG, or by the encoder given. `plans.images.write_image_files` writes files."""
    coded = F.udf(lambda pixels, width: encode(pixels, width), "binary")
    images.select("class", "name", coded("pixels", "width").alias("content")).write.mode("append").partitionBy("class").parquet(path)


def write_features(rows: DataFrame, path: str) -> None:
    """Feature vectors: img_id, label, kind (lbp, glcm, hist, combined, ...), vector. One folder a kind."""
    rows.select("img_id", "label", "kind", F.col("vector").cast("array<float>").alias("vector")).write.mode("overwrite").partitionBy("kind").parquet(path)


def read_features(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """img_id, label, vector of one kind."""
    return spark.read.parquet(path).filter(F.col("kind") == kind).select("img_id", "label", "vector")


def write_texts(results: DataFrame, path: str) -> None:
    """Raw and normalised texts, one folder a class."""
    results.select("class", "path", "raw", "processed").write.mode("append").partitionBy("class").parquet(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """One term a line, in sorted order over the part files."""
    vocab.select("term").orderBy("term").write.mode("overwrite").text(path)


def report_lines(report: DataFrame) -> DataFrame:
    """The printed form of `evaluate.full_report`: model, place, line; metrics with four digits."""
    place = F.when(F.col("class") == "accuracy", 1).when(F.col("class") == "macro avg", 2).when(F.col("class") == "weighted avg", 3).otherwise(0)
    number = lambda c: F.coalesce(F.format_string("%10.4f", c), F.lit(" " * 10))
    metrics = [F.when(F.col(c).isNull(), F.lit(" " * 10)).otherwise(number(F.col(c))) for c in ("precision", "recall", "f1")]
    return report.select("model", place.alias("place"), "class", F.concat(F.rpad("class", 26, " "), *metrics, F.format_string("%9d", F.col("support"))).alias("line"))


def write_report(report: DataFrame, path: str) -> None:
    report_lines(report).orderBy("model", "place", "class").select(F.concat_ws("  ", "model", "line").alias("value")).write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.select("model", "kind", "accuracy", "precision", "recall", "f1").write.mode("overwrite").json(path)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)
