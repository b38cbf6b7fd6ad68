"""Image kernels on numpy arrays, from published descriptions: LBP (I1), resizing and CLAHE (I4), Otsu (I5), and their Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lbp_histogram(image: np.ndarray, points: int = 24, radius: float = 3.0) -> np.ndarray:
    """Relative frequencies of uniform local binary patterns: codes 0..points by ones, points + 1 for more than two changes.

    Neighbours are sampled on the circle by bilinear interpolation; what lies outside the image counts as 0.
    """
    return lbp_histograms(image[None], points, radius)[0]


def lbp_histograms(images: np.ndarray, points: int = 24, radius: float = 3.0) -> np.ndarray:
    """The histogram of each of several images of one size."""
    n, height, width = images.shape
    margin = int(np.ceil(radius)) + 1
    padded = np.pad(images.astype(np.float64), ((0, 0), (margin, margin), (margin, margin)))
    bits = np.empty((points, n, height, width), dtype=bool)
    for k in range(points):
        dy, dx = -radius * np.sin(2 * np.pi * k / points), radius * np.cos(2 * np.pi * k / points)
        dy, dx = round(dy, 5), round(dx, 5)
        y, x = int(np.floor(dy)), int(np.floor(dx))
        fy, fx = dy - y, dx - x
        at = lambda a, b: padded[:, margin + a : margin + a + height, margin + b : margin + b + width]
        sample = (1 - fy) * ((1 - fx) * at(y, x) + fx * at(y, x + 1)) + fy * ((1 - fx) * at(y + 1, x) + fx * at(y + 1, x + 1))
        bits[k] = np.round(sample, 6) >= images
    changes = (bits != np.roll(bits, 1, axis=0)).sum(axis=0)
    codes = np.where(changes <= 2, bits.sum(axis=0), points + 1) + np.arange(n)[:, None, None] * (points + 2)
    return np.bincount(codes.ravel(), minlength=n * (points + 2)).reshape(n, points + 2) / (height * width)


def resize(image: np.ndarray, size: int) -> np.ndarray:
    """Area averaging if both sides exceed size, else bilinear interpolation at pixel centres."""
    if min(image.shape) > size:
        rows, columns = (_area(n, size) for n in image.shape)
    else:
        rows, columns = (_linear(n, size) for n in image.shape)
    return np.clip(np.rint(rows @ image.astype(np.float64) @ columns.T), 0, 255).astype(np.uint8)


def _area(n: int, size: int) -> np.ndarray:
    edges = np.arange(size + 1) * n / size
    cells = np.arange(n)
    overlap = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    return np.clip(overlap, 0, None) * size / n


def _linear(n: int, size: int) -> np.ndarray:
    centre = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    low = np.minimum(np.floor(centre).astype(int), max(n - 2, 0))
    out = np.zeros((size, n))
    out[np.arange(size), low] += 1 - (centre - low)
    out[np.arange(size), np.minimum(low + 1, n - 1)] += centre - low
    return out


def clahe(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation, tiles x tiles regions, bilinear between their mappings."""
    height, width = image.shape
    padded = np.pad(image, ((0, -height % tiles), (0, -width % tiles)), mode="reflect" if min(height, width) > tiles else "edge")
    th, tw = padded.shape[0] // tiles, padded.shape[1] // tiles
    limit = max(1, int(clip * th * tw / 256))
    maps = np.empty((tiles, tiles, 256))
    for a in range(tiles):
        for b in range(tiles):
            histogram = np.bincount(padded[a * th : (a + 1) * th, b * tw : (b + 1) * tw].ravel(), minlength=256)
            excess = int(np.maximum(histogram - limit, 0).sum())
            histogram = np.minimum(histogram, limit) + excess // 256
            rest = excess % 256
            if rest:
                histogram[:: max(256 // rest, 1)][:rest] += 1
            maps[a, b] = np.clip(np.rint(np.cumsum(histogram) * 255 / (th * tw)), 0, 255)
    y, x = (np.arange(height) + 0.5) / th - 0.5, (np.arange(width) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    row = lambda k: np.clip(k, 0, tiles - 1)[:, None]
    column = lambda k: np.clip(k, 0, tiles - 1)[None, :]
    value = lambda a, b: maps[row(a), column(b), image]
    out = (1 - fy) * ((1 - fx) * value(y0, x0) + fx * value(y0, x0 + 1)) + fy * ((1 - fx) * value(y0 + 1, x0) + fx * value(y0 + 1, x0 + 1))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def preprocess(image: np.ndarray, size: int = 128) -> np.ndarray:
    return clahe(resize(image, size))


def otsu_threshold(image: np.ndarray) -> int:
    n = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w1 = w0[-1] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(w0 * w1 * (s0 / w0 - (s0[-1] - s0) / w1) ** 2)
    return int(np.argmax(np.where(n > 0, np.round(between, 6), -1.0)))  # a value that occurs


def glcm_descriptors(levels: np.ndarray, dy: int, dx: int) -> tuple[float, float, float, float, float]:
    """Contrast, dissimilarity, homogeneity, energy and correlation of the symmetric co-occurrence of grey levels at an offset."""
    return tuple(glcm_rows(levels[None], dy, dx)[0].tolist())


def glcm_rows(levels: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The descriptors of each of several images of one size. Sums are of integers, so they are exact."""
    n, height, width = levels.shape
    left, right = max(0, -dx), width - max(0, dx)
    a = levels[:, : height - dy, left:right].reshape(n, -1).astype(np.int64)
    b = levels[:, dy:, left + dx : right + dx].reshape(n, -1).astype(np.int64)
    size, square = a.shape[1], (a - b) ** 2
    codes = np.sort(np.concatenate([a * 256 + b, b * 256 + a], axis=1), axis=1)
    place = np.arange(2 * size)
    begins = np.concatenate([np.ones((n, 1), dtype=bool), codes[:, 1:] != codes[:, :-1]], axis=1)
    rank = place - np.maximum.accumulate(np.where(begins, place, 0), axis=1)
    same = (2 * rank + 1).sum(axis=1)  # the sum of the squared counts
    total, product = (a + b).sum(axis=1), (a * b).sum(axis=1)
    spread, shared = 2 * size * (a * a + b * b).sum(axis=1) - total * total, 4 * size * product - total * total
    correlation = np.where(spread == 0, 1.0, shared / np.where(spread == 0, 1, spread))
    return np.stack([square.sum(axis=1) / size, abs(a - b).sum(axis=1) / size, (1 / (1 + square)).sum(axis=1) / size, np.sqrt(same) / (2 * size), correlation], axis=1)


#: Pixels of images that are described together, about.
PIXELS = 1 << 16


def _by_size(batch: pd.Series, width: int, kind: type, f) -> list:
    """For each array of grey values a row of f(images x rows x columns); images of one size go together."""
    arrays = [np.asarray(p, dtype=kind) for p in batch]
    sizes, out = np.array([len(p) for p in arrays], dtype=np.int64), [None] * len(arrays)
    for size in np.unique(sizes):
        own, step = np.flatnonzero(sizes == size), max(1, PIXELS // max(1, int(size)))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            for k, row in zip(part, f(np.stack([arrays[k] for k in part]).reshape(len(part), size // width, width)), strict=True):
                out[k] = row
    return out


def glcm_column(pixels: Column, width: int, offsets: list[tuple[int, int]], step: int = 4) -> Column:
    """One struct an offset that the image has room for."""
    names = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")

    @F.pandas_udf("array<struct<dy: int, dx: int, " + ", ".join(f"{n}: double" for n in names) + ">>")
    def run(batch: pd.Series) -> pd.Series:
        def described(images: np.ndarray) -> list[list[dict]]:
            fit = [(dy, dx) for dy, dx in offsets if dy < images.shape[1] and abs(dx) < width]
            once = {o: glcm_rows(images // step, *o).tolist() for o in set(fit)}
            return [[{"dy": dy, "dx": dx} | dict(zip(names, once[dy, dx][k], strict=True)) for dy, dx in fit] for k in range(len(images))]

        return pd.Series(_by_size(batch, width, np.int64, described))

    return run(pixels)


def histogram_column(pixels: Column, bins: int = 256) -> Column:
    """Relative frequencies of the grey values 0 to bins - 1."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda p: np.bincount(np.asarray(p, dtype=np.int64), minlength=bins) / len(p))

    return run(pixels)


def otsu_column(pixels: Column) -> Column:
    @F.pandas_udf("int")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda p: otsu_threshold(np.asarray(p, dtype=np.int64)))

    return run(pixels)


def lbp_column(pixels: Column, width: int, points: int = 24, radius: float = 3.0) -> Column:
    """LBP histograms of images given as arrays of grey values, row by row."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(_by_size(batch, width, np.float64, lambda images: list(lbp_histograms(images, points, radius))))

    return run(pixels)


def preprocess_column(pixels: Column, width: Column | int, size: int) -> Column:
    @F.pandas_udf("array<int>")
    def run(batch: pd.Series, widths: pd.Series) -> pd.Series:
        return pd.Series([preprocess(np.asarray(p, dtype=np.uint8).reshape(-1, w), size).ravel().astype(np.int32) for p, w in zip(batch, widths, strict=True)])

    return run(pixels, F.lit(width) if isinstance(width, int) else width)


def sinc_weights(n: int, size: int, lobes: int = 3) -> np.ndarray:
    """(size, n): weights of a windowed sinc (Lanczos) of so many lobes, widened where the image shrinks; rows sum to 1."""
    scale = max(n / size, 1.0)
    centre = (np.arange(size) + 0.5) * n / size
    x = (np.arange(n)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def tensor(image: np.ndarray, size: int) -> np.ndarray:
    """size x size values from 0 to 1: rows, then columns, each rounded to grey levels, then divided by 255."""
    rows, columns = (sinc_weights(n, size) for n in image.shape)
    across = np.clip(np.rint(image.astype(np.float64) @ columns.T), 0, 255)
    return np.clip(np.rint(rows @ across), 0, 255) / 255


def tensor_column(pixels: Column, width: Column, size: int) -> Column:
    @F.pandas_udf("array<float>")
    def run(batch: pd.Series, widths: pd.Series) -> pd.Series:
        return pd.Series([tensor(np.asarray(p, dtype=np.uint8).reshape(-1, w), size).ravel().astype(np.float32) for p, w in zip(batch, widths, strict=True)])

    return run(pixels, width)
