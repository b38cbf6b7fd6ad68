"""PNG and BMP files to grey arrays and back, in numpy, from the published formats.

PNG: all colour types (grey, RGB, palette, with alpha) at every bit depth, the five row filters, interlacing; chunks must bear
their checksums. BMP: 1, 4, 8, 24 and 32 bits, bottom-up or top-down, uncompressed. Colours become grey by the usual luma
weights (299, 587, 114 of 1000, rounded); alpha is left aside; 16 bits keep their high byte.

A damaged file raises ValueError, and so does one whose header asks for more than MOST_PIXELS; the image plan turns that into
a null and counts it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type, and the bit depths that each may have.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: First row, first column, row step and column step of the seven passes of an interlaced image.
PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]
MOST_PIXELS = 1 << 28


def luma(rgb: np.ndarray) -> np.ndarray:
    """Grey of the last axis' red, green and blue."""
    weighted = rgb[..., :3].astype(np.uint32) @ np.array([299, 587, 114], dtype=np.uint32)
    return ((weighted + 500) // 1000).astype(np.uint8)


# ---- PNG --------------------------------------------------------------------------------------------------------


def _chunks(data: bytes) -> dict[bytes, bytes]:
    """Bodies by kind; those of one kind end to end."""
    found: dict[bytes, list[bytes]] = {}
    at = len(PNG_MAGIC)
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("a damaged chunk")
        found.setdefault(kind, []).append(body)
        at += 12 + size
        if kind == b"IEND":
            return {k: b"".join(v) for k, v in found.items()}
    raise ValueError("the file ends early")


def _unfiltered(raw: np.ndarray, rows: int, width: int, step: int) -> np.ndarray:
    """Rows of `width` bytes from rows that begin with the number of their filter; `step` bytes lie between neighbours."""
    lines = raw.reshape(rows, width + 1)
    out = np.zeros((rows + 1, width + step), dtype=np.uint8)  # a zero row above and zero pixels to the left
    for r in range(rows):
        kind, line, above, here = int(lines[r, 0]), lines[r, 1:], out[r], out[r + 1]
        if kind == 0:
            here[step:] = line
        elif kind == 2:
            here[step:] = line + above[step:]
        elif kind == 1:  # running sums of each channel, modulo 256
            padded = np.zeros(-(-width // step) * step, dtype=np.uint8)
            padded[:width] = line
            here[step:] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:width]
        elif kind == 3:
            for x in range(width):
                here[step + x] = (int(line[x]) + (int(here[x]) + int(above[step + x])) // 2) & 255
        elif kind == 4:
            for x in range(width):
                a, b, c = int(here[x]), int(above[step + x]), int(above[x])
                pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                here[step + x] = (int(line[x]) + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
        else:
            raise ValueError("an unknown filter")
    return out[1:, step:]


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """(height, width, channels) of values of `depth` bits; of 16 bits the high byte."""
    if depth == 16:
        return rows.reshape(len(rows), width, channels, 2)[..., 0]
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)[:, : width * channels]
    return (bits @ (1 << np.arange(depth - 1, -1, -1, dtype=np.uint8))).astype(np.uint8).reshape(len(rows), width, channels)


def read_png(data: bytes) -> np.ndarray:
    if not data.startswith(PNG_MAGIC):
        raise ValueError("not a PNG file")
    chunks = _chunks(data)
    if len(chunks.get(b"IHDR", b"")) != 13:
        raise ValueError("no header")
    width, height, depth, colour, packing, filtering, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    if depth not in DEPTHS.get(colour, ()) or packing or filtering or interlaced > 1 or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("an unknown format")
    channels = CHANNELS[colour]
    passes = [(a, b, c, d) for a, b, c, d in PASSES if a < height and b < width] if interlaced else [(0, 0, 1, 1)]
    shapes = [(-(-(height - a) // c), -(-(width - b) // d)) for a, b, c, d in passes]
    widths = [-(-w * channels * depth // 8) for _, w in shapes]
    size = sum(h * (n + 1) for (h, _), n in zip(shapes, widths, strict=True))
    try:
        raw = np.frombuffer(zlib.decompressobj().decompress(chunks.get(b"IDAT", b""), size), dtype=np.uint8)
    except zlib.error as error:
        raise ValueError("damaged pixels") from error
    if len(raw) != size:
        raise ValueError("pixels are missing")
    values, at = np.zeros((height, width, channels), dtype=np.uint8), 0
    for (a, b, c, d), (h, w), n in zip(passes, shapes, widths, strict=True):
        rows = _unfiltered(raw[at : at + h * (n + 1)], h, n, max(1, channels * depth // 8))
        values[a::c, b::d] = _samples(rows, w, channels, depth)
        at += h * (n + 1)
    if colour == 3:
        palette = np.frombuffer(chunks.get(b"PLTE", b""), dtype=np.uint8)
        if not len(palette) or len(palette) % 3 or int(values.max()) >= len(palette) // 3:
            raise ValueError("colours are missing")
        return luma(palette.reshape(-1, 3))[values[..., 0]]
    if colour in (2, 6):
        return luma(values)
    return values[..., 0] * np.uint8(255 // ((1 << depth) - 1)) if depth < 8 else values[..., 0].copy()


def write_png(image: np.ndarray) -> bytes:
    """An 8-bit grey file; each row has the filter of least absolute differences among none, left and above."""
    image = np.asarray(image, dtype=np.uint8)
    height, width = image.shape
    left, above = image.copy(), image.copy()
    left[:, 1:] -= image[:, :-1]
    above[1:] -= image[:-1]
    choices = np.stack([image, left, above])
    best = np.abs(choices.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    rows = np.concatenate([best[:, None].astype(np.uint8), choices[best, np.arange(height)]], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


# ---- BMP --------------------------------------------------------------------------------------------------------


def read_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP file")
    (start,) = struct.unpack("<I", data[10:14])
    size, width, height, _, depth, packing = struct.unpack("<IiiHHI", data[14:34])
    flip, height = height > 0, abs(height)
    plain = packing == 0 or (packing == 3 and depth == 32)
    if size < 40 or depth not in (1, 4, 8, 24, 32) or not plain or width <= 0 or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("an unknown format")
    stride = (width * depth + 31) // 32 * 4
    raw = np.frombuffer(data[start : start + stride * height], dtype=np.uint8)
    if len(raw) != stride * height:
        raise ValueError("pixels are missing")
    rows = raw.reshape(height, stride)
    if depth > 8:
        values = luma(rows[:, : width * depth // 8].reshape(height, width, depth // 8)[..., 2::-1])
    else:
        (colours,) = struct.unpack("<I", data[46:50])
        table = np.frombuffer(data[14 + size : 14 + size + 4 * (colours or 1 << depth)], dtype=np.uint8)
        numbers = _samples(rows, width, 1, depth)[..., 0] if depth < 8 else rows[:, :width]
        if len(table) % 4 or int(numbers.max()) >= len(table) // 4:
            raise ValueError("colours are missing")
        values = luma(table.reshape(-1, 4)[:, 2::-1])[numbers]
    return values[::-1].copy() if flip else values.copy()


def write_bmp(image: np.ndarray) -> bytes:
    """An 8-bit file with a grey palette, bottom-up."""
    image = np.asarray(image, dtype=np.uint8)
    height, width = image.shape
    rows = np.zeros((height, (width + 3) // 4 * 4), dtype=np.uint8)
    rows[:, :width] = image[::-1]
    palette = np.zeros((256, 4), dtype=np.uint8)
    palette[:, :3] = np.arange(256, dtype=np.uint8)[:, None]
    start = 54 + palette.nbytes
    header = b"BM" + struct.pack("<IHHI", start + rows.nbytes, 0, 0, start)
    return header + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.nbytes, 2835, 2835, 256, 0) + palette.tobytes() + rows.tobytes()


def read_image(data: bytes) -> np.ndarray:
    """A grey array from a PNG or BMP file, told apart by their first bytes."""
    return read_bmp(data) if data[:2] == b"BM" else read_png(data)
