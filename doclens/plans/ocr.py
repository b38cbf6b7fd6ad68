"""The OCR plan (I5-I7, A9-A11): images to raw and normalised text with a pluggable engine, one result row an image.

An engine is a function from image bytes to text, built once a partition; none is bundled. An image that cannot be decoded
(or an engine that fails) gives a null text: it counts as a failure, `failures` lists it and `readable` drops it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.functions.stemming import normalize_stemmed
from doclens.functions.text import strip
from doclens.operators.ingest import pending


def run_ocr(images: DataFrame, build: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """path, class, raw, processed, ok, len_raw, len_processed and samples of 500 characters."""

    def recognise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = build()
        for batch in batches:
            texts = []
            for content in batch.column("content").to_pylist():
                try:
                    texts.append(engine(content) or "")
                except Exception:  # one unreadable image must not end the run
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("class"), pa.array(texts, pa.string())], ["path", "class", "raw"])

    read = images.select("path", "class", "content").mapInArrow(recognise, "path string, class string, raw string")
    return ocr_results(read.withColumn("raw", strip(F.col("raw"))))


def failures(results: DataFrame) -> DataFrame:
    """Images that could not be decoded or read at all, by class."""
    return results.filter(~F.col("decoded")).groupBy("class").agg(F.count(F.lit(1)).alias("failed"))


def readable(results: DataFrame) -> DataFrame:
    """The results of the images that could be decoded."""
    return results.filter("decoded")


def ocr_results(read: DataFrame, normalizer: Callable[[Column], Column] = normalize_stemmed) -> DataFrame:
    """Results of raw texts (null where the image could not be read), normalised with stems unless another normaliser is given."""
    processed = read.withColumn("decoded", F.col("raw").isNotNull()).withColumn("raw", F.coalesce("raw", F.lit(""))).withColumn("processed", normalizer(F.col("raw")))
    return processed.withColumns({
        "ok": F.length("raw") > 0, "len_raw": F.length("raw").cast("long"), "len_processed": F.length("processed").cast("long"),
        "sample_raw": F.substring("raw", 1, 500), "sample_processed": F.substring("processed", 1, 500),
    })


def resume(images: DataFrame, results: DataFrame, build: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """Results of the images without a non-empty result yet."""
    return run_ocr(pending(images, results.withColumn("size", F.length("processed")), "path"), build)


def ocr_statistics(results: DataFrame) -> DataFrame:
    """One row a class and a TOTAL: counts, rate, and lengths over successes only (0 where there are none)."""
    ok = lambda c: F.when(F.col("ok"), F.col(c))
    grouped = results.rollup("class").agg(
        F.grouping("class").alias("is_total"), F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("successes"),
        F.coalesce(F.avg(ok("len_raw")), F.lit(0.0)).alias("avg_len_raw"), F.coalesce(F.avg(ok("len_processed")), F.lit(0.0)).alias("avg_len_processed"),
        F.coalesce(F.max(ok("len_processed")), F.lit(0)).cast("long").alias("max_len"), F.coalesce(F.min(ok("len_processed")), F.lit(0)).cast("long").alias("min_len"),
    )
    return grouped.select(F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("class")).alias("class"), "total", "successes", F.round(F.col("successes") / F.col("total") * 100, 6).alias("rate"), F.round("avg_len_raw", 6).alias("avg_len_raw"), F.round("avg_len_processed", 6).alias("avg_len_processed"), "max_len", "min_len")


def examples(results: DataFrame, least: int = 50, classes: int = 4) -> DataFrame:
    """The first success of more than `least` raw characters of each class, for the first few classes."""
    first = results.filter(F.col("ok") & (F.col("len_raw") > least)).groupBy("class").agg(F.min_by(F.struct("path", "sample_raw", "sample_processed"), "path").alias("e"))
    return first.orderBy("class").limit(classes).select("class", "e.*")
