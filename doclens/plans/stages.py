"""Runs of several stages, resumed where they stopped, and the training of all models with a cache of their metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.operators.evaluate import comparison, model_metrics
from doclens.sources.corpus import cached_metrics
from doclens.sources.sinks import write_metrics


def written(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that was written to its end, or None."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def run_stages(spark: SparkSession, stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], root: str, again: bool = False) -> dict[str, DataFrame]:
    """Runs stages in order, each from the results so far by name; results are Parquet under root. A stage whose result is there
    is not run again unless asked for. The first stage that fails ends the run; those before it keep their results."""
    done: dict[str, DataFrame] = {}
    for name, stage in stages:
        path = f"{root}/{name}"
        found = None if again else written(spark, path)
        if found is None:
            stage(done).write.mode("overwrite").parquet(path)
            found = spark.read.parquet(path)
        done[name] = found
    return done


def train_all(spark: SparkSession, models: list[tuple[str, str, Callable[[], DataFrame]]], path: str) -> DataFrame:
    """The comparison of models (name, kind, function giving label and predicted): metrics at `path` are taken from there, only
    the other models are trained, and all metrics are written back."""
    held = cached_metrics(spark, path)
    rows = [] if held is None else [r.asDict() for r in held.collect()]  # a row a model
    for name, kind, predict in models:
        if not any(r["model"] == name for r in rows):
            found = predict().select(F.lit(name).alias("model"), "label", "predicted")
            rows.append(model_metrics(found).first().asDict() | {"kind": kind})
    order = {name: k for k, (name, _, _) in enumerate(models)}
    kept = [(r["model"], r["kind"], order[r["model"]], *(float(r[c]) for c in ("accuracy", "precision", "recall", "f1"))) for r in rows if r["model"] in order]
    table = spark.createDataFrame(kept, "model string, kind string, ord int, accuracy double, precision double, recall double, f1 double")
    write_metrics(table, path)
    return comparison(table)
