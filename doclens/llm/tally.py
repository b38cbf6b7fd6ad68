"""Counts over a whole corpus, gathered block by block.

A block is what one Python call sees of the corpus; it reduces its keys (64-bit hashes) to distinct ones with counts, cuts
them into buckets of the key space and sends each part as one binary value. A bucket adds up the parts that it gets and
returns the totals to each block in the order in which they came, so keys travel once, counts come back, and a key that a
third of all documents hold is one entry a block. Nothing is collected on the driver.

Numbers travel as byte planes under zstd, sorted keys as differences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PART = "block long, bucket int, keys binary, counts binary"
TOTALS = "block long, bucket int, totals binary"


def squeeze(a: np.ndarray) -> bytes:
    """The array's bytes, all first bytes, then all second bytes and so on, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
    packed = pa.compress(planes, "zstd", asbytes=True) if len(planes) > 64 else planes
    return len(planes).to_bytes(8, "little") + packed


def unsqueeze(data: bytes, kind: str) -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True) if size > 64 else data[8:], dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind)


def parts(keys: np.ndarray, counts: np.ndarray, buckets: int, bits: int = 64, limit: int = 1 << 64) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, keys, counts) of sorted distinct keys below `limit`, which the buckets share evenly.

    Of each key its `bits` high bits are sent; keys equal in them share a total.
    """
    bounds = np.array([b * limit // buckets for b in range(1, buckets)], dtype=np.uint64)
    at = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    high = keys >> np.uint64(64 - bits)
    for b, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if hi > lo:
            yield b, squeeze(np.diff(high[lo:hi], prepend=np.uint64(0))), squeeze(counts[lo:hi].astype("<u4"))


def joined(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Squeezed arrays end to end, and their n + 1 offsets."""
    arrays = [unsqueeze(x, kind) for x in column.to_pylist()]
    sizes = np.array([0, *(len(a) for a in arrays)], dtype=np.int64)
    return (np.concatenate(arrays) if arrays else np.zeros(0, dtype=kind)), np.cumsum(sizes)


def by_key(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """df dealt to `tasks` tasks by key: a number that the caller derives from the size of its input, so that no task grows with it."""
    return df.repartition(max(1, tasks), key)


def _totals(arrays: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of sorted key arrays with counts: each one's totals, and the totals of the distinct keys. Keys are added up range by range."""
    size = sum(map(len, arrays))
    n = max(1, size >> 20)
    longest = max(arrays, key=len)
    edges = [longest[len(longest) * k // n] for k in range(1, n)]
    cuts = [[0, *np.searchsorted(a, np.array(edges, dtype=np.uint64)).tolist(), len(a)] for a in arrays]
    back, distinct = [np.empty(len(a), dtype="<i8") for a in arrays], []
    for k in range(n):
        own = [slice(c[k], c[k + 1]) for c in cuts]
        keys = np.concatenate([a[s] for a, s in zip(arrays, own, strict=True)])
        _, which = np.unique(keys, return_inverse=True)
        sums = np.bincount(which, weights=np.concatenate([c[s] for c, s in zip(counts, own, strict=True)])).astype("<i8")
        distinct.append(sums)
        at = 0
        for b, s in zip(back, own, strict=True):
            b[s] = sums[which[at : at + s.stop - s.start]]
            at += s.stop - s.start
    return back, np.concatenate(distinct)


def add_up(spread: DataFrame, tasks: int, stats_of: Callable | None = None, stats: str = "", bits: int | Callable[[int], int] = 64, shared: int = 0) -> DataFrame:
    """Rows of TOTALS from rows of PART. `stats_of` (totals of the bucket's distinct keys -> integers) adds a row of block -1 a bucket.

    With `shared`, the column of that name holds each block's keys (their `bits` high bits) of at least that total.
    """
    names = [f.split()[0] for f in stats.split(",") if f.strip()]

    def run(key: tuple, group: pa.Table) -> pa.Table:
        shift = np.uint64(64 - (bits(key[0].as_py()) if callable(bits) else bits))
        arrays = [np.cumsum(unsqueeze(x, "<u8"), dtype=np.uint64) << shift for x in group.column("keys").to_pylist()]
        back, sums = _totals(arrays, [unsqueeze(x, "<u4") for x in group.column("counts").to_pylist()])
        blocks = group.column("block").to_pylist()
        out = {"block": blocks, "bucket": [key[0].as_py()] * len(blocks), "totals": [squeeze(b) for b in back]}
        if shared:
            out["shared"] = [squeeze(a[b >= shared]) for a, b in zip(arrays, back, strict=True)]
        out |= {n: [None] * len(blocks) for n in names}
        if stats_of is not None:
            last = {"block": -1, "bucket": key[0].as_py()} | dict(zip(names, map(int, stats_of(sums)), strict=True))
            for n, column in out.items():
                column.append(last.get(n))
        types = [pa.int64(), pa.int32(), pa.binary(), *[pa.binary()] * bool(shared), *[pa.int64()] * len(names)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out.values(), types, strict=True)], names=list(out))

    schema = TOTALS + ", shared binary" * bool(shared) + (f", {stats}" if stats else "")
    return by_key(spread.select("block", "bucket", "keys", "counts"), "bucket", tasks).groupBy("bucket").applyInArrow(run, schema)


def totals_in_order(group: pa.Table, shared: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A block's totals in the order of its sorted distinct keys, and the keys where add_up was told to share them (else 0)."""
    group = group.sort_by("bucket")
    totals, _ = joined(group.column("totals"), "<i8")
    keys = np.zeros(len(totals), dtype=np.uint64)
    if shared:
        keys[totals >= shared] = joined(group.column("shared"), "<u8")[0]
    return totals, keys
