"""Quotas, numbering, resume and repair of image manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions.text import numbered_file, renamed_file
from doclens.operators.joins import null_safe_join
from doclens.operators.numbering import numbered, range_of

#: The two class orders in use. The position of a name is its integer label.
ALPHABETICAL = [
    "advertisement", "budget", "email", "file_folder", "form", "handwritten",
    "invoice", "letter", "memo", "news_article", "presentation", "questionnaire",
    "resume", "scientific_publication", "scientific_report", "specification",
]
CUSTOM = [
    "letter", "form", "email", "handwritten", "advertisement", "scientific_report",
    "scientific_publication", "specification", "file_folder", "news_article", "budget", "invoice",
    "presentation", "questionnaire", "resume", "memo",
]


def class_cap(rows: DataFrame, class_col: str, order: list[str], cap: int) -> DataFrame:
    """The first `cap` rows of each class in the given order; Spark keeps only so many before the shuffle."""
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(class_col).orderBy(*order)))
    return numbered.filter(F.col("__n") <= cap).drop("__n")


def running_number(rows: DataFrame, class_col: str, order: list[str], existing: DataFrame | None = None, name: str = "n") -> DataFrame:
    """rows with their number in the class, continuing from `existing` (class, n) where given."""
    found = numbered(rows, order, range_of(rows, order[0]), [class_col], name)
    if existing is None:
        return found
    return null_safe_join(found, existing.select(F.col(class_col), F.col("n").alias("__have")), class_col, "left").withColumn(name, F.col(name) + F.coalesce("__have", F.lit(0))).drop("__have")


def numbered_files(rows: DataFrame, class_col: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    return running_number(rows, class_col, order, existing).withColumn("file_name", numbered_file(F.col(class_col), F.col("n")))


def deficits(have: DataFrame, classes: DataFrame, target: int, class_col: str = "class") -> DataFrame:
    """class, existing, missing for every class short of target."""
    counts = have.groupBy(class_col).agg(F.count(F.lit(1)).alias("existing"))
    joined = null_safe_join(classes.select(class_col).distinct(), counts, class_col, "left").select(class_col, F.coalesce("existing", F.lit(0)).alias("existing"))
    return joined.withColumn("missing", F.greatest(F.lit(target) - F.col("existing"), F.lit(0)).cast("long"))


def pending(work: DataFrame, done: DataFrame, key: str, least_size: int | None = 1, size_col: str = "size") -> DataFrame:
    """Work without an output yet; with least_size, outputs smaller than that do not count (J4), else any does."""
    found = done if least_size is None else done.filter(F.col(size_col) >= least_size)
    return work.join(found.select(key), key, "left_anti")


def with_all_versions(originals: DataFrame, versions: list[DataFrame], key: str) -> DataFrame:
    for version in versions:
        originals = originals.join(version.select(key), key, "left_semi")
    return originals


def resolved_class(class_name: Column, label: Column, classes: list[str]) -> Column:
    """class_name if known, else the class of a label in range, else null."""
    names = F.array(*map(F.lit, classes))
    by_label = F.when((label >= 0) & (label < len(classes)), F.try_element_at(names, label + 1))
    return F.coalesce(F.when(class_name.isin(classes), class_name), by_label)


def corrected_class(class_name: Column) -> Column:
    """The class that was meant where a label was read in the custom instead of the alphabetical order."""
    pairs = [F.lit(x) for pair in zip(CUSTOM, ALPHABETICAL, strict=True) for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), class_name), class_name)


def repaired_manifest(rows: DataFrame) -> DataFrame:
    """Manifest rows (path, class_name, label) with class, file name and path put right."""
    new = corrected_class(F.col("class_name"))
    name = renamed_file(new, F.substring_index("path", "/", -1))
    return rows.select(F.concat(new, F.lit("/"), name).alias("path"), new.alias("class_name"), "label")


def class_index(rows: DataFrame, class_col: str) -> DataFrame:
    """rows with class_id, the place of the class among the sorted distinct ones, null first (P10, M12). Classes are few."""
    names = rows.select(class_col).distinct()
    return null_safe_join(rows, F.broadcast(names.withColumn("class_id", (F.dense_rank().over(Window.orderBy(F.asc_nulls_first(class_col))) - 1).cast("int"))), class_col)


def missing_classes(present: DataFrame, expected: DataFrame, class_col: str) -> DataFrame:
    return null_safe_join(expected.select(class_col).distinct(), present.select(class_col).distinct(), class_col, "left_anti")


def hits_with_images(hits: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Hits with the path of their image, or a placeholder."""
    return hits.join(images.select(key, F.col("path").alias("__image")), key, "left").withColumn("image_path", F.coalesce("__image", F.lit("(no image)"))).drop("__image")
