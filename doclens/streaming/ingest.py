"""Incremental ingestion on Structured Streaming (R1-R4, W1, W2, J4, J12): row files to a quota a class, resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclens.operators.ingest import deficits, numbered_files, running_number


def row_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def top_up(existing: DataFrame, arriving: DataFrame, classes: DataFrame, target: int, order: list[str], key: str) -> DataFrame:
    """The arriving rows that a class still needs, new keys only, numbered and named after what exists (class, key)."""
    fresh = arriving.join(existing.select(key), key, "left_anti").dropDuplicates([key])
    have = existing.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    missing = deficits(existing, classes, target).select("class", "missing")
    wanted = running_number(fresh, "class", order, name="arrival").join(F.broadcast(missing), "class").filter(F.col("arrival") <= F.col("missing"))
    return numbered_files(wanted.drop("arrival", "missing"), "class", order, have)


def ingest(stream: DataFrame, out: str, checkpoint: str, classes: DataFrame, target: int, order: list[str], key: str, interval: str | None = None) -> StreamingQuery:
    """Appends to `out` until every class has `target` rows. A batch that is run again replaces its own folder, so restarts add nothing twice."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        schema = "class string, " + f"{key} {rows.schema[key].dataType.simpleString()}, batch long"
        try:
            existing = spark.read.parquet(out).filter(F.col("batch") < number).select("class", key)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            existing = spark.createDataFrame([], schema).select("class", key)
        top_up(existing, rows, classes, target, order, key).withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("batch").parquet(out)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def quota_reached(existing: DataFrame, classes: DataFrame, target: int) -> bool:
    return deficits(existing, classes, target).filter("missing > 0").isEmpty()
