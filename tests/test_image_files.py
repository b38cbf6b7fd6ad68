"""Image files: every PNG format against a plain encoder, BMP, damage, and the way from files to features and back."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doclens.functions import image_codecs as ic
from doclens.functions.image_kernels import lbp_column
from doclens.plans import images as pi
from doclens.sources.corpus import image_files
from doclens.sources.sinks import write_encoded_images


def filtered(line, above, kind, step):
    out = bytearray([kind])
    for x, v in enumerate(line):
        a, b, c = (line[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
        p = a + b - c
        paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
    return bytes(out)


def plain_png(samples, depth, colour, interlaced=False, palette=b"", parts=1):
    """A file of samples (rows of pixels of channel values), row after row with the next filter."""
    height, width, channels = len(samples), len(samples[0]), len(samples[0][0])
    grids = [(0, 0, 1, 1)] if not interlaced else ic.PASSES
    raw, step, kind = b"", max(1, channels * depth // 8), 0
    for a, b, c, d in grids:
        rows = [samples[y][b::d] for y in range(a, height, c)] if b < width else []
        above = None
        for row in rows:
            bits = "".join(f"{v:0{depth}b}" for pixel in row for v in pixel)
            bits += "0" * (-len(bits) % 8)
            line = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
            raw += filtered(line, above or bytes(len(line)), kind % 5, step)
            above, kind = line, kind + 1
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    packed = zlib.compress(raw)
    cuts = [len(packed) * k // parts for k in range(parts + 1)]
    data = b"".join(chunk(b"IDAT", packed[x:y]) for x, y in zip(cuts, cuts[1:], strict=False))
    return ic.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"tEXt", b"a\0b") + data + chunk(b"IEND", b"")


def grey_of(pixel, depth, colour, palette):
    if colour == 3:
        pixel, colour, depth = tuple(palette[3 * pixel[0] : 3 * pixel[0] + 3]), 2, 8
    eight = [v >> 8 if depth == 16 else v * 255 // ((1 << depth) - 1) for v in pixel]
    return (299 * eight[0] + 587 * eight[1] + 114 * eight[2] + 500) // 1000 if colour in (2, 6) else eight[0]


@pytest.mark.parametrize(("colour", "depth"), [(c, d) for c, depths in ic.DEPTHS.items() for d in depths])
@pytest.mark.parametrize("interlaced", [False, True])
def test_every_png_format(colour, depth, interlaced):
    rng = np.random.default_rng(colour * 20 + depth)
    for height, width in ((1, 1), (3, 2), (13, 11), (9, 17)):
        palette = rng.integers(0, 256, 3 * (1 << depth), dtype=np.uint8).tobytes() if colour == 3 else b""
        samples = rng.integers(0, 1 << depth, (height, width, ic.CHANNELS[colour])).tolist()
        expected = [[grey_of(p, depth, colour, palette) for p in row] for row in samples]
        assert ic.read_image(plain_png(samples, depth, colour, interlaced, palette, parts=3)).tolist() == expected


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(0, 2**32 - 1))
def test_round_trips(height, width, seed):
    image = np.random.default_rng(seed).integers(0, 256, (height, width), dtype=np.uint8)
    assert np.array_equal(ic.read_image(ic.write_png(image)), image)
    assert np.array_equal(ic.read_image(ic.write_bmp(image)), image)


@pytest.mark.parametrize("depth", [1, 4, 8, 24, 32])
@pytest.mark.parametrize("down", [False, True])
def test_bmp_depths(depth, down):
    rng, height, width = np.random.default_rng(depth), 5, 7
    if depth > 8:
        rgb = rng.integers(0, 256, (height, width, depth // 8), dtype=np.uint8)
        lines, table = [row.tobytes() for row in rgb], b""
        expected = ic.luma(rgb[..., 2::-1])
    else:
        palette = rng.integers(0, 256, (1 << depth, 4), dtype=np.uint8)
        numbers = rng.integers(0, 1 << depth, (height, width))
        lines = [int("".join(f"{v:0{depth}b}" for v in row).ljust((width * depth + 7) // 8 * 8, "0"), 2).to_bytes((width * depth + 7) // 8) for row in numbers.tolist()]
        table, expected = palette.tobytes(), ic.luma(palette[:, 2::-1])[numbers]
    lines = [x + bytes(-len(x) % 4) for x in (lines if down else lines[::-1])]
    start = 54 + len(table)
    data = b"BM" + struct.pack("<IHHI", 0, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, -height if down else height, 1, depth, 0, 0, 0, 0, 0, 0) + table + b"".join(lines)
    assert np.array_equal(ic.read_image(data), expected)


def test_damaged_files_raise():
    good = ic.write_png(np.arange(100, dtype=np.uint8).reshape(10, 10))
    bad = [b"", b"BM", b"nothing", good[:-13], good[:40], good.replace(b"IDAT", b"IDAX"), good[:45] + bytes([good[45] ^ 1]) + good[46:], ic.write_bmp(np.zeros((4, 4)))[:-1]]
    huge = struct.pack(">IIBBBBB", 1 << 31 - 1, 1 << 20, 8, 0, 0, 0, 0)
    bad.append(ic.PNG_MAGIC + struct.pack(">I", 13) + b"IHDR" + huge + struct.pack(">I", zlib.crc32(b"IHDR" + huge)) + good[33:])
    for data in bad:
        with pytest.raises(ValueError):
            ic.read_image(data)


@pytest.fixture
def tree(tmp_path):
    rng = np.random.default_rng(2)
    for k, name in enumerate(["memo", "form"]):
        (tmp_path / "in" / name).mkdir(parents=True)
        for j in range(3):
            image = rng.integers(0, 256, (20 + j, 31), dtype=np.uint8)
            data = ic.write_png(image) if j else ic.write_bmp(image)
            (tmp_path / "in" / name / f"{name}_{j}.{'png' if j else 'bmp'}").write_bytes(data if (k, j) != (1, 2) else data[:-20])
    return tmp_path


def test_from_files_to_features_and_back(spark, tree):
    files = image_files(spark, str(tree / "in"))
    images = pi.decode_images(files)
    assert {(r["name"], r["height"], r["width"]) for r in images.filter("pixels IS NULL").collect()} == {("form_2.png", None, None)}
    counts = pi.process_images(files, str(tree / "out"), (16, 32)).orderBy("resolution").collect()
    assert [tuple(r) for r in counts] == [(16, 5, 1), (32, 5, 1)]
    processed = spark.read.parquet(str(tree / "out"))
    assert {(r["resolution"], r["n"], r["size"]) for r in processed.groupBy("resolution").agg(F.count("*").alias("n"), F.max(F.size("pixels")).alias("size")).collect()} == {(16, 5, 256), (32, 5, 1024)}
    expected = {(r["name"], tuple(r["pixels"])) for r in pi.preprocessed(images, 16).collect()}
    assert {(r["name"], tuple(r["pixels"])) for r in processed.filter("resolution = 16").collect()} == expected

    written = pi.write_image_files(processed.filter("resolution = 16").select("class", "name", "pixels", F.lit(16).alias("width")), str(tree / "png"))
    assert written.count() == 5 and written.filter("length > 50").count() == 5
    again = pi.decode_images(image_files(spark, str(tree / "png")))
    assert {(r["name"].replace(".png", ""), tuple(r["pixels"])) for r in again.collect()} == {(n.rsplit(".", 1)[0], p) for n, p in expected}
    assert again.select(F.size(lbp_column(F.col("pixels"), 16)).alias("n")).agg(F.min("n"), F.max("n")).first()[:] == (26, 26)

    write_encoded_images(again.filter("name = 'memo_0.png'"), str(tree / "coded"))
    content = spark.read.parquet(str(tree / "coded")).first()["content"]
    assert np.array_equal(ic.read_png(bytes(content)).ravel(), again.filter("name = 'memo_0.png'").first()["pixels"])


def test_files_are_decoded_once(spark, tree):
    calls = spark.sparkContext.accumulator(0)

    def build():
        def decode(data):
            calls.add(1)
            return ic.read_image(data)

        return decode

    pi.process_images(image_files(spark, str(tree / "in")), str(tree / "once"), (16, 32), build)
    assert calls.value == 6


def test_images_of_one_size_are_described_together():
    from doclens.functions import image_kernels as ik

    rng = np.random.default_rng(4)
    images = np.concatenate([rng.integers(0, 64, (30, 8, 8)), np.full((2, 8, 8), 5)])
    for dy, dx in ((0, 1), (1, 1), (2, -2)):
        found = ik.glcm_rows(images, dy, dx)
        for image, row in zip(images, found, strict=True):
            a, b = image[: 8 - dy, max(0, -dx) : 8 - max(0, dx)].ravel(), image[dy:, max(0, -dx) + dx : 8 - max(0, dx) + dx].ravel()
            i, j = np.concatenate([a, b]), np.concatenate([b, a])
            _, n = np.unique(i * 256 + j, return_counts=True)
            correlation = 1.0 if i.std() == 0 else ((i * j).mean() - i.mean() ** 2) / i.var()
            assert np.allclose(row, [((i - j) ** 2).mean(), abs(i - j).mean(), (1 / (1 + (i - j) ** 2)).mean(), np.sqrt(((n / n.sum()) ** 2).sum()), correlation])
    assert (ik.lbp_histograms(images) == np.stack([ik.lbp_histogram(image) for image in images])).all()
