"""Descriptors of images.

An image is one row: descriptors are computed inside the row by Arrow kernels, without a shuffle. The same descriptors over
pixel tables (one row a pixel) are here for images that come as such tables, and to check the kernels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions.image_kernels import glcm_column, histogram_column, otsu_column

#: Distances and angles of the co-occurrence matrix as row and column offsets; 45 degrees rounds to (1, 1) for 1 and 2.
OFFSETS = [(round(d * y), round(d * x)) for d in (1, 2, 3) for y, x in ((0.0, 1.0), (0.7071, 0.7071), (1.0, 0.0), (0.7071, -0.7071))]


def grey_images(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """id, label, pixels: a vector's values scaled to 0..255 by its own range (0 where it is constant)."""
    low, high = F.array_min(vector).cast("double"), F.array_max(vector).cast("double")
    pixel = lambda e: F.when(high == low, F.lit(0)).otherwise(F.floor((e.cast("double") - low) / (high - low) * 255)).cast("int")
    return vectors.select(F.col(id_col).alias("img_id"), "label", F.transform(vector, pixel).alias("pixels"))


def image_histograms(images: DataFrame) -> DataFrame:
    """img_id, v, freq (rounded to 6 digits) for every grey value."""
    return images.select("img_id", F.posexplode(histogram_column(F.col("pixels"))).alias("v", "f")).select("img_id", "v", F.round("f", 6).alias("freq"))


def image_glcm(images: DataFrame, width: int, offsets: list[tuple[int, int]] | None = None, step: int = 4) -> DataFrame:
    """img_id, dy, dx and the five descriptors of each offset, rounded to 6 digits."""
    found = images.select("img_id", F.explode(glcm_column(F.col("pixels"), width, offsets or sorted(set(OFFSETS)), step)).alias("g"))
    return found.select("img_id", "g.dy", "g.dx", *(F.round(f"g.{c}", 6).alias(c) for c in ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")))


def image_otsu(images: DataFrame) -> DataFrame:
    """img_id, threshold."""
    return images.select("img_id", otsu_column(F.col("pixels")).alias("threshold"))


def image_binarised(images: DataFrame, width: int) -> DataFrame:
    """img_id, y, x, v: 255 above the image's threshold, else 0."""
    at = F.col("threshold")
    marked = images.withColumn("threshold", otsu_column(F.col("pixels"))).withColumn("pixels", F.transform("pixels", lambda v: F.when(v > at, 255).otherwise(0)))
    return pixel_table(marked, width).select("img_id", "y", "x", "v")


def pixel_table(images: DataFrame, width: int) -> DataFrame:
    exploded = images.select("img_id", "label", F.posexplode("pixels").alias("i", "v"))
    return exploded.select("img_id", "label", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).alias("x"), "v")


def intensity_histogram(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """img_id, v, freq for every bin, empty ones included; frequencies of an image sum to 1."""
    counts = pixels.groupBy("img_id", "v").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("img_id").agg(F.sum("n").alias("total")).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return totals.join(counts, ["img_id", "v"], "left").select("img_id", "v", F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("freq"))


def glcm_pairs(pixels: DataFrame, dy: int, dx: int, step: int = 4) -> DataFrame:
    """img_id, i, j: quantised grey levels of pixel pairs at an offset, in both directions."""
    level = F.floor(F.col("v") / step).cast("long")
    here = pixels.select("img_id", "y", "x", level.alias("i"))
    there = pixels.select("img_id", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), level.alias("j"))
    one = here.join(there, ["img_id", "y", "x"]).select("img_id", "i", "j")
    return one.unionByName(one.select("img_id", F.col("j").alias("i"), F.col("i").alias("j")))


def glcm_features(pixels: DataFrame, offsets: list[tuple[int, int]] | None = None, step: int = 4) -> DataFrame:
    """img_id, dy, dx, contrast, dissimilarity, homogeneity, energy, correlation (1 for a constant image), rounded to 6 digits."""
    out = None
    for dy, dx in offsets or sorted(set(OFFSETS)):
        cells = glcm_pairs(pixels, dy, dx, step).groupBy("img_id", "i", "j").agg(F.count(F.lit(1)).alias("n"))
        p = cells.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("img_id")))
        gap = F.col("i") - F.col("j")
        sums = p.groupBy("img_id").agg(
            F.sum(F.col("p") * gap * gap).alias("contrast"), F.sum(F.col("p") * F.abs(gap)).alias("dissimilarity"), F.sum(F.col("p") / (1 + gap * gap)).alias("homogeneity"),
            F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("energy"), F.sum(F.col("p") * F.col("i")).alias("mean"), F.sum(F.col("p") * F.col("i") * F.col("i")).alias("square"), F.sum(F.col("p") * F.col("i") * F.col("j")).alias("product"),
        )
        variance = F.col("square") - F.col("mean") * F.col("mean")
        correlation = F.when(variance < 1e-12, F.lit(1.0)).otherwise((F.col("product") - F.col("mean") * F.col("mean")) / F.when(variance < 1e-12, F.lit(1.0)).otherwise(variance))
        found = sums.select("img_id", F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), *(F.round(c, 6).alias(c) for c in ("contrast", "dissimilarity", "homogeneity", "energy")), F.round(correlation, 6).alias("correlation"))
        out = found if out is None else out.unionByName(found)
    return out


def otsu_thresholds(pixels: DataFrame) -> DataFrame:
    """img_id, threshold: the grey level t that maximises between-class variance of <= t and > t; the smallest such t."""
    counts = pixels.groupBy("img_id", "v").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("img_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.partitionBy("img_id")
    c = counts.select("img_id", "v", F.sum("n").over(so_far).alias("w0"), F.sum(F.col("n") * F.col("v")).over(so_far).alias("s0"), F.sum("n").over(all_of).alias("w"), F.sum(F.col("n") * F.col("v")).over(all_of).alias("s"))
    w1 = F.col("w") - F.col("w0")
    gap = F.try_divide(F.col("s0").cast("double"), F.col("w0")) - F.try_divide((F.col("s") - F.col("s0")).cast("double"), w1)
    between = F.round(F.coalesce(F.col("w0") * w1 * gap * gap, F.lit(0.0)), 6)
    return c.groupBy("img_id").agg(F.min_by("v", F.struct(-between, F.col("v"))).alias("threshold"))


def binarised(pixels: DataFrame) -> DataFrame:
    return pixels.join(otsu_thresholds(pixels), "img_id").withColumn("v", F.when(F.col("v") > F.col("threshold"), 255).otherwise(0)).drop("threshold")


def class_profile(histogram: DataFrame, labels: DataFrame) -> DataFrame:
    """label, v, mean, deviation (population) and lower band max(mean - deviation, 0) over the images of a class."""
    found = histogram.join(labels, "img_id").groupBy("label", "v").agg(F.avg("freq").alias("m"), F.stddev_pop("freq").alias("s"))
    return found.select("label", "v", F.round("m", 8).alias("mean"), F.round("s", 8).alias("deviation"), F.round(F.greatest(F.col("m") - F.col("s"), F.lit(0.0)), 8).alias("lower"))


def first_argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
