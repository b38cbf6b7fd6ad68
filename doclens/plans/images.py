"""From image files to arrays and back: decoding with nulls for what cannot be read, counts taken by the write itself, files of
processed images (S7, S8, F12, A18, I11, K1, K2)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from doclens.functions.image_codecs import read_image, write_png
from doclens.functions.image_kernels import preprocess, preprocess_column, tensor_column
from doclens.session import cut


def decode_images(files: DataFrame, build: Callable[[], Callable[[bytes], np.ndarray]] = lambda: read_image) -> DataFrame:
    """path, class, name, pixels (row after row, 0 to 255), height and width; the last three are null where decoding failed.

    A decoder is a function from a file's bytes to a grey array of two dimensions, built once a task: PNG and BMP if no other is given.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = build()
        for batch in batches:
            found: list[tuple] = []
            for content in batch.column("content").to_pylist():
                try:
                    image = np.asarray(decoder(content), dtype=np.uint8)
                    height, width = image.shape
                    found.append((image.ravel().astype(np.int32), height, width))
                except Exception:  # one unreadable image must not end the run
                    found.append((None, None, None))
            arrays = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.list_(pa.int32()), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "class", "name")), *arrays], ["path", "class", "name", "pixels", "height", "width"])

    kept = files.filter("content IS NOT NULL").select("path", "class", "name", "content")
    return kept.mapInArrow(read, "path string, class string, name string, pixels array<int>, height int, width int")


def readable(images: DataFrame) -> DataFrame:
    """The images that could be decoded."""
    return images.filter("pixels IS NOT NULL")


def processing_counts(images: DataFrame, resolutions: tuple[int, ...] = (128, 256)) -> DataFrame:
    """resolution, successes, errors: every image counts once for each resolution."""
    counted = images.agg(F.count("pixels").alias("successes"), (F.count(F.lit(1)) - F.count("pixels")).alias("errors"))
    return counted.select(F.explode(F.array(*map(F.lit, resolutions))).alias("resolution"), "successes", "errors")


def process_images(files: DataFrame, path: str, resolutions: tuple[int, ...] = (128, 256), build: Callable[[], Callable[[bytes], np.ndarray]] = lambda: read_image) -> DataFrame:
    """Writes every readable image at each resolution (class, name, pixels, by resolution and class under path), and returns resolution, successes, errors.

    Files are read and decoded once: the counts are observed by the write. It has no shuffle, so a task that is run again is counted once.
    """
    seen = Observation()
    images = decode_images(files, build).observe(seen, F.count(F.lit(1)).alias("files"), F.count("pixels").alias("readable"))
    schema = "resolution int, class string, name string, pixels array<int>"

    def resized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):  # one image at a time: at the larger resolutions a batch of them would be much
                pixels = batch.column("pixels")[r].values
                image = pixels.to_numpy().astype(np.uint8).reshape(-1, batch.column("width")[r].as_py())
                sides = [preprocess(image, size).ravel().astype(np.int32) for size in resolutions]
                named = [[batch.column(c)[r].as_py()] * len(sides) for c in ("class", "name")]
                yield pa.RecordBatch.from_arrays([pa.array(resolutions, pa.int32()), *(pa.array(c, pa.string()) for c in named), pa.array(sides, pa.list_(pa.int32()))], ["resolution", "class", "name", "pixels"])

    readable(images).mapInArrow(resized, schema).write.mode("append").partitionBy("resolution", "class").parquet(path)
    counts = seen.get
    return files.sparkSession.createDataFrame([(size, counts["readable"], counts["files"] - counts["readable"]) for size in resolutions], "resolution int, successes long, errors long")


def write_image_files(images: DataFrame, root: str, encode: Callable[[np.ndarray], bytes] = write_png, extension: str = "png") -> DataFrame:
    """Writes images (class, name, pixels, width) as root/{class}/{stem}.{extension} and returns path and length of the files.

    A file is written beside its place and then moved, so a task that is run again, or twice at once, leaves whole files. `root` is
    a folder, or an address, that all tasks reach. Two images of one class and stem are one file, the last one written.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
        for batch in batches:
            done: list[tuple[str, int]] = []
            for row in batch.to_pylist():
                folder = f"{base.rstrip('/')}/{row['class']}"
                path, data = f"{folder}/{row['name'].rsplit('.', 1)[0]}.{extension}", encode(np.array(row["pixels"], dtype=np.uint8).reshape(-1, row["width"]))
                store.create_dir(folder, recursive=True)
                beside = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(data)
                store.move(beside, path)
                done.append((path, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "length"])

    return cut(images.select("class", "name", "pixels", "width").mapInArrow(write, "path string, length long"), "image-files")


def preprocessed(images: DataFrame, size: int) -> DataFrame:
    """class, name, pixels of size x size: resized and equalised."""
    return readable(images).select("class", "name", preprocess_column(F.col("pixels"), F.col("width"), size).alias("pixels"))


def tensors(images: DataFrame, size: int = 128) -> DataFrame:
    """class, name, tensor: size x size values from 0 to 1, by windowed-sinc resampling."""
    return readable(images).select("class", "name", tensor_column(F.col("pixels"), F.col("width"), size).alias("tensor"))
