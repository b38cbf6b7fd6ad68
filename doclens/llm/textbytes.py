"""Vectorised text scanning: a column of texts as one UTF-8 byte array, its words, lines and hashes as numpy arrays.

Hashes are 64-bit. A text is never cut short; `row_blocks` only bounds how many rows are looked at together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but digits, letters and what is beyond ASCII, once A-Z are lower-case.
NOT_WORD = np.zeros(256, dtype=bool)
NOT_WORD[0x00:0x30] = NOT_WORD[0x3A:0x61] = NOT_WORD[0x7B:0x80] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for key, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.ones(1, dtype=np.uint64)
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            _powers[key] = out
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of a well-known public 64-bit hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, end to end, and their n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if at is not None and len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes together; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def pieces(column: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of blocks of rows."""
    data, offsets = column_bytes(column)
    for a, b in row_blocks(offsets, most):
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def cut_long(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in which rows of more than `most` bytes are cut into parts, and the row of each part.

    A cut comes after the last white space of a part, or at `most` bytes where there is none.
    """
    sizes = np.diff(offsets)
    if not len(sizes) or sizes.max() <= most:
        return offsets, np.arange(len(sizes))
    at, rows = [0], []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a > most:
            gaps = np.flatnonzero(SPACE[data[a : a + most]])
            a += int(gaps[-1]) + 1 if len(gaps) else most
            at.append(a)
            rows.append(row)
        at.append(b)
        rows.append(row)
    return np.array(at, dtype=np.int64), np.array(rows, dtype=np.int64)


def spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of bytes that `apart` (a table over bytes) does not mark. Runs end with their row."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~apart[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def ranges(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most `most` bytes that end between words or rows; where one word is longer, it stays whole."""
    n, at = len(data), 0
    while at < n:
        to = min(n, at + most)
        if to < n:
            row = max(at, int(offsets[np.searchsorted(offsets, to, "right") - 1]))
            gaps = np.flatnonzero(apart[data[row:to]])
            to = row + int(gaps[-1]) + 1 if len(gaps) else row
            if to <= at:  # one word so far: on to its end
                ahead = int(offsets[np.searchsorted(offsets, at + most, "right")])
                gaps = np.flatnonzero(apart[data[at + most : ahead]])
                to = at + most + int(gaps[0]) if len(gaps) else ahead
        yield at, to
        at = to


def rows_within(offsets: np.ndarray, at: int, to: int) -> tuple[int, np.ndarray]:
    """The first row that has bytes of the range, and the offsets, within it, of that row and the others that have."""
    first, last = int(np.searchsorted(offsets, at, "right")) - 1, int(np.searchsorted(offsets, to, "left"))
    return first, np.clip(offsets[first : last + 1], at, to) - at


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE, most: int = 1 << 20, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (A-Z lower-cased, unless fold is false), start, end and row of every word of the texts. What is worked on at once is bounded, so the memory for a long text is that of its words' numbers."""
    found: list[tuple] = [(np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 3)]
    for at, to in ranges(data, offsets, apart, most):
        part = LOWER[data[at:to]] if fold else data[at:to]
        first, own = rows_within(offsets, at, to)
        a, b, r = spans(part, own, apart)
        found.append((span_hash(prefix_hash(part), a, b), a + at, b + at, r + first))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run between white space."""
    hashes, _, _, rows = words(data, offsets)
    return hashes, rows


_STEP = [np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64) | 1) for k in range(64)]


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i:i+n] for each i; shorter than words by n - 1."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out += words[k : k + size] * _STEP[k]
    return mix(out)


def sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Per-row totals as int64."""
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64) if len(rows) else np.zeros(n, dtype=np.int64)
