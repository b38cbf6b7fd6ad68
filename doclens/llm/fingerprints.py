"""Operator 13, document fingerprints by one-permutation MinHash.

A text's elements are its distinct shingles of five lower-case words (A-Z; words as runs between white space), or the whole
sequence where it has fewer. One hash of each shingle picks a bin by its high bits and competes there by the rest, so every
shingle is hashed once, whatever the number of bins. An empty bin borrows: it tries the others in a fixed pseudo-random
order of its own and copies the first filled one (optimal densification: two texts with the same shingles fill alike, and
no neighbourhood of a filled bin is favoured). Of each bin the low bits are packed; as two unlike values of `bits` bits agree
by chance once in 2**bits times, the share of equal bins is corrected for that.

The next document is found by dealing rows by range of (id, hash of the text), each range sorted: a row's successor is the
next of its range, and the last of a range meets the first of the next one through a join of the ranges' edges, one row each.
Texts pass one shuffle; each is fingerprinted once, each edited text once.

Defined cases. A null text is empty. A text without words has an empty fingerprint: its likeness is 1 to another such text
and 0 to any other. Ids ascend with null first; rows of one id go by the hash of their texts, equal ones in any order. A
single row is its own successor. Further columns are not read; an empty table gives an empty result. Long texts are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import bound_batches, buckets_for, cut, give_back, table, text_of
from doclens.llm.textbytes import mix, pieces, window_hash, word_hashes

BLOCK = 1 << 20


@dataclass(frozen=True)
class Sketch:
    """Words a shingle, bins (a power of two), and bits kept of each (a divisor of 8)."""

    n: int = 5
    bins: int = 256
    bits: int = 4


@lru_cache(maxsize=4)
def borrowing_order(bins: int) -> np.ndarray:
    """By bin, the other bins in the order in which it tries them."""
    others = np.arange(bins)[None, :] + np.arange(1, bins)[:, None]  # step, bin
    return np.random.Generator(np.random.PCG64(13)).permuted(others % bins, axis=0).T.astype(np.int32)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle, repeated ones too."""
    words, rows = word_hashes(data, offsets)
    size = max(0, len(words) - n + 1)
    whole = np.flatnonzero(rows[:size] == rows[n - 1 : n - 1 + size])
    hashes, of = window_hash(words, n)[whole], rows[whole]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.searchsorted(rows, short)
        own = np.array([int(window_hash(words[a : a + c], int(c))[0]) for a, c in zip(first.tolist(), counts[short].tolist(), strict=True)], dtype=np.uint64)
        hashes, of = np.concatenate([hashes, own]), np.concatenate([of, short])
    return hashes, of


def minima(hashes: np.ndarray, rows: np.ndarray, n: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Least hash by row and bin, densified, and which rows have any."""
    shift = np.uint64(64 - (bins.bit_length() - 1))
    least = np.full(n * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, rows * bins + (hashes >> shift).astype(np.int64), hashes)
    least = least.reshape(n, bins)
    filled = np.zeros(n * bins, dtype=bool)
    filled[rows * bins + (hashes >> shift).astype(np.int64)] = True
    filled = filled.reshape(n, bins)
    any_ = filled.any(axis=1)
    row, at = np.nonzero(~filled & any_[:, None])
    order = borrowing_order(bins)
    for k in range(bins - 1):
        if not len(row):
            break
        tried = order[at, k]
        full = filled[row, tried]
        least[row[full], at[full]] = least[row[full], tried[full]]
        row, at = row[~full], at[~full]
    return least, any_


def pack(least: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of each row's values, packed into bytes, first value highest.

    A value is hashed with its bin before, so that in short texts, where many bins hold one value, chance is met anew in each.
    """
    each = 8 // bits
    least = mix(least ^ mix(np.arange(1, least.shape[1] + 1, dtype=np.uint64)))
    low = (least & np.uint64((1 << bits) - 1)).astype(np.uint8).reshape(len(least), -1, each)
    out = np.zeros(low.shape[:2], dtype=np.uint8)
    for k in range(each):
        out |= low[:, :, k] << np.uint8(bits * (each - 1 - k))
    return out


def fingerprints(column: pa.Array, sketch: Sketch) -> list[bytes]:
    """One of each text; empty where it has no words."""
    out: list[bytes] = []
    for _, data, offsets in pieces(column, BLOCK):
        n = len(offsets) - 1
        least, any_ = minima(*shingle_hashes(data, offsets, sketch.n), n, sketch.bins)
        packed = pack(least, sketch.bits)
        out += [packed[r].tobytes() if any_[r] else b"" for r in range(n)]
    return out


def likeness(a: list[bytes], b: list[bytes], sketch: Sketch) -> np.ndarray:
    """Estimated Jaccard similarity of pairs of fingerprints: the share of equal bins without what agrees by chance."""
    empty = np.array([not x or not y for x, y in zip(a, b, strict=True)], dtype=bool)
    out = np.array([float(x == y) for x, y in zip(a, b, strict=True)])
    if (both := np.flatnonzero(~empty)).size:
        width = sketch.bins * sketch.bits // 8
        x, y = (np.frombuffer(b"".join(s[k] for k in both), dtype=np.uint8).reshape(-1, width) for s in (a, b))
        differ, mask = x ^ y, np.uint8((1 << sketch.bits) - 1)
        same = sum(((differ >> np.uint8(k)) & mask == 0).sum(axis=1) for k in range(0, 8, sketch.bits)) / sketch.bins
        chance = 1 / (1 << sketch.bits)
        out[both] = np.clip((same - chance) / (1 - chance), 0, 1)
    return out


def edited(text: str, after: str) -> str:
    """The text with its last half, rounded down, replaced by as much of the next one's beginning, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


REPORT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _report(texts: list[str], prints: list[bytes], nexts: list[str], next_prints: list[bytes], sketch: Sketch) -> list[pa.Array]:
    """REPORT for texts with their successors; edited texts are made and dropped a block at a time."""
    digests, own = [], []
    at = 0
    while at < len(texts):
        block, size = [], 0
        while at + len(block) < len(texts) and (not block or size < BLOCK):
            block.append(edited(texts[at + len(block)], nexts[at + len(block)]))
            size += len(block[-1])
        digests += [hashlib.sha256(t.encode()).hexdigest() for t in block]
        own += fingerprints(pa.array(block, pa.large_string()), sketch)
        at += len(block)
    columns = [[len(t) for t in texts], digests, [p.hex() for p in prints], [p.hex() for p in own], likeness(prints, own, sketch), likeness(prints, next_prints, sketch)]
    return [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]


_FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_successors(docs: DataFrame, sketch: Sketch | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and REPORT of each row."""
    sketch, spark = sketch or Sketch(), docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.asc_nulls_first("id"), F.asc("tie")]
    dealt = rows.repartitionByRange(buckets_for(rows, 8 << 20), *order).sortWithinPartitions(*order).drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: tuple | None = None

        def edge(kind_: str, row: tuple, schema: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"id": row[0], "edge": kind_, "part": part, "text": row[1], "print": row[2].hex()}], schema)

        for batch in batches:
            schema = pa.schema([batch.schema.field("id"), *(pa.field(n, t) for n, t in zip(REPORT, _TYPES, strict=True)), ("edge", pa.string()), ("part", pa.int32()), ("text", pa.string()), ("print", pa.string())])
            if not batch.num_rows:
                continue
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            prints = fingerprints(batch.column("text"), sketch)
            if last is None:
                yield edge("first", (ids[0], texts[0], prints[0]), schema)
            else:
                ids, texts, prints = [last[0], *ids], [last[1], *texts], [last[2], *prints]
            last = (ids[-1], texts[-1], prints[-1])
            if n := len(ids) - 1:
                nulls = [pa.nulls(n, t) for t in (pa.string(), pa.int32(), pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], schema.field("id").type), *_report(texts[:-1], prints[:-1], texts[1:], prints[1:], sketch), *nulls], schema=schema)
        if last is not None:
            yield edge("last", last, schema)
        give_back()

    bound_batches(spark)
    done = cut(dealt.mapInArrow(run, f"id {kind}, {_FIELDS}, edge string, part int, text string, print string"), "fingerprints")
    edges = done.filter("edge IS NOT NULL").select("id", "edge", "part", "text", "print")
    parts = sorted(r["part"] for r in edges.filter("edge = 'last'").select("part").collect())  # numbers of tasks
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, then int")
    heads = edges.filter("edge = 'first'").select(F.col("part").alias("then"), F.col("text").alias("next_text"), F.col("print").alias("next_print"))
    pairs = edges.filter("edge = 'last'").join(follows, "part").join(heads, "then").select("id", "text", "print", "next_text", "next_print")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, prints, nexts, next_prints = (batch.column(c).to_pylist() for c in ("text", "print", "next_text", "next_print"))
            unhex = lambda xs: [bytes.fromhex(x) for x in xs]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_report(texts, unhex(prints), nexts, unhex(next_prints), sketch)], ["id", *REPORT])

    closed = pairs.mapInArrow(close, f"id {kind}, {_FIELDS}")
    return done.filter("edge IS NULL").select("id", *REPORT).unionByName(closed).withColumnRenamed("id", id_col)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_successors(table(spark, sf_dir, "documents"))
