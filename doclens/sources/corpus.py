"""Corpora as DataFrames: text corpora (S4-S6, F1, F2), image trees (S1-S3), Parquet, CSV and JSON inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.functions.text import class_of_path, file_name, stem, strip

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")
MANIFEST = "path string, class_name string, label int"
EXTENDED_MANIFEST = f"{MANIFEST}, source_image_path string, width int, height int, format string, file_size_bytes long, split string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_path(class_name: Column, doc_id: Column) -> Column:
    """class/class_id.txt with at least five digits; lpad would shorten longer ids."""
    name = doc_id.cast("string")
    return F.concat(class_name, F.lit("/"), class_name, F.lit("_"), F.lpad(name, F.greatest(F.lit(5), F.length(name)), F.lit("0")), F.lit(".txt"))


def documents_corpus(spark: SparkSession, sf_dir: str, min_chars: int = 1, class_col: str = "lang") -> DataFrame:
    """doc_id, class, path, text (stripped), for texts of at least min_chars after stripping."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col(class_col).alias("class"), strip(F.col("text")).alias("text"))
    return docs.filter(F.length("text") >= min_chars).select("doc_id", "class", text_path(F.col("class"), F.col("doc_id")).alias("path"), "text")


def text_corpus(spark: SparkSession, root: str, min_chars: int = 1) -> DataFrame:
    """path, class, stem, text of the .txt files under root/{class}/."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    found = files.select(F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("text")).filter(F.length("text") >= min_chars)
    return found.select("path", class_of_path(F.col("path")).alias("class"), stem(F.col("path")).alias("stem"), "text")


def image_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS, cap: int | None = None) -> DataFrame:
    """path, class, name, length, content of the image files under root/{class}/, at most `cap` a class in order of name."""
    from doclens.operators.ingest import class_cap

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    found = files.select("path", class_of_path(F.col("path")).alias("class"), file_name(F.col("path")).alias("name"), "length", "content")
    return found if cap is None else class_cap(found, "class", ["name", "path"], cap)


def manifest(spark: SparkSession, path: str, extended: bool = False) -> DataFrame:
    return spark.read.schema(EXTENDED_MANIFEST if extended else MANIFEST).csv(path, header=True)


def write_manifest(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").csv(path, header=True)


def decoded_images(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of Parquet shards with their base64 image as binary."""
    return spark.read.parquet(*paths).withColumn("content", F.unbase64("image_base64"))


def cached_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """Metrics saved before, or None where there are none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("model string, kind string, accuracy double, precision double, recall double, f1 double").json(path)
    except AnalysisException:
        return None


def scraped_accuracy(lines: DataFrame, column: str = "value") -> DataFrame:
    """First `Accuracy...: number` of each report text."""
    return lines.withColumn("accuracy", F.regexp_extract(column, r"Accuracy.*?:\s*([\d.]+)", 1).try_cast("double"))
