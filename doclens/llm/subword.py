"""Operator 1, a quality classifier on supervised subword embeddings.

A document is the plain average of the learned vectors of all its features, every occurrence counted: its words, its pairs
of adjacent words, and the character n-grams (of code points) of its running text, each hashed to a bucket of its own range
of one table. A pair of equal words is one feature, whatever the word. A softmax layer over that average gives the classes.
Vectors and layer are trained together by stochastic gradient descent in numpy on a bounded sample of labelled
rows. Since the output is linear in the average, scoring looks up one number a feature, in numpy, over whole texts.

Defined cases. A null or empty text has no features: its score is what the layer's bias gives. Without a labelled row of
either class every score is the share of label 1 (0.5 without any). Null labels are not learned from. Rows are scored one
by one, so repeated rows, null ids and further columns change nothing; an empty table gives an empty result. Texts of more
than `BLOCK` bytes are read in parts cut at white space; all parts count, but no pair or n-gram spans a cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import bound_batches, crc_mod, hash_share, share_for, table
from doclens.llm.textbytes import SPACE, column_bytes, cut_long, pieces, prefix_hash, span_hash, spans

BLOCK = 1 << 19
#: Stands for the hash of every pair of equal words.
SAME = np.uint64(0x2545F4914F6CDD1D)
_STEPS = [np.uint32(pow(0x9E3779B1, k + 1, 1 << 32)) for k in range(16)]


@dataclass(frozen=True)
class Settings:
    """`sample_rows` and `sample_bytes` bound the labelled sample: so many rows at most, none of a longer text."""

    buckets_log2: int = 16
    dims: int = 8
    ngrams: tuple[int, ...] = (3, 4, 5)
    epochs: int = 8
    rate: float = 5.0
    sample_rows: int = 3000
    sample_bytes: int = 20_000


def features(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every feature. Words and their pairs are in the lower half of the table, character n-grams in the upper."""
    half = s.buckets_log2 - 1
    starts, ends, rows = spans(data, offsets, SPACE)
    prefix = prefix_hash(data)
    place = lambda hashed: ((hashed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - half)).astype(np.int32)
    word = span_hash(prefix, starts, ends)
    pair = np.where(word[1:] == word[:-1], SAME, word[:-1] * np.uint64(0xD1342543DE82EF95) + word[1:])
    inside = np.flatnonzero(rows[1:] == rows[:-1])
    buckets, of = [place(word), place(pair[inside])], [rows, rows[inside]]
    first = np.flatnonzero((data & 0xC0) != 0x80)  # of each character
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(first, offsets)))
    code = span_hash(prefix, first, np.append(first[1:], len(data))).astype(np.uint32)
    rolled = np.zeros(len(first), dtype=np.uint32)
    for k in range(max(s.ngrams)):
        size = max(0, len(first) - k)
        rolled = rolled[:size] + code[k : k + size] * _STEPS[k]
        if k + 1 in s.ngrams:
            inside = np.flatnonzero(row_of[:size] == row_of[k:])
            found = ((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - half)
            buckets.append(found.astype(np.int32)[inside] + np.int32(1 << half))
            of.append(row_of[inside])
    return np.concatenate(buckets), np.concatenate(of)


def step(vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray, ids: np.ndarray, weight: np.ndarray, label: int, rate: float) -> None:
    """One step of gradient descent, in place, on the cross entropy of one document: distinct buckets `ids` with shares `weight`."""
    held = vectors[ids]
    mean = weight @ held
    logits = mean @ layer + bias
    p = np.exp(logits - logits.max())
    p /= p.sum()
    p[label] -= 1
    vectors[ids] = held - rate * weight[:, None] * (layer @ p)
    layer -= rate * np.outer(mean, p)
    bias -= rate * p


def train(texts: pa.Array, labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Numbers per bucket and bias: the log-odds of class 1 are bias + the average of the numbers of a document's features."""
    size = 1 << s.buckets_log2
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(size, dtype=np.float32), float(np.log(share / (1 - share)))
    bags = []
    for _, data, offsets in pieces(texts, BLOCK):
        found, row = features(data, offsets, s)
        n = len(offsets) - 1
        whole = np.bincount(row, minlength=n)
        keys, counts = np.unique(row.astype(np.int64) << s.buckets_log2 | found, return_counts=True)
        weights = (counts / whole[keys >> s.buckets_log2]).astype(np.float32)
        at = np.searchsorted(keys >> s.buckets_log2, np.arange(n + 1))
        bags.extend(((keys[a:b] & (size - 1)).astype(np.int32), weights[a:b]) for a, b in zip(at[:-1], at[1:], strict=True))
    rng = np.random.Generator(np.random.PCG64(11))
    vectors = rng.uniform(-0.5, 0.5, (size, s.dims)).astype(np.float32) / s.dims
    layer, bias = rng.normal(0, 1, (s.dims, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        for k in rng.permutation(len(bags)):
            ids, weight = bags[k]
            if len(ids):
                step(vectors, layer, bias, ids, weight, int(labels[k]), rate)
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def score(column: pa.Array, numbers: np.ndarray, bias: float, s: Settings) -> np.ndarray:
    data, offsets = column_bytes(column)
    parts, part_row = cut_long(data, offsets, BLOCK)
    n = len(offsets) - 1
    total, count = np.zeros(n), np.zeros(n)
    first = 0
    while first < len(part_row):
        last = max(first + 1, int(np.searchsorted(parts, parts[first] + BLOCK, "right")) - 1)
        own = parts[first : last + 1]
        bucket, row = features(data[own[0] : own[-1]], own - own[0], s)
        row = part_row[first:last][row]
        total += np.bincount(row, weights=numbers[bucket], minlength=n)
        count += np.bincount(row, minlength=n)
        first = last
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -60, 60)))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, learn, rows: int, most_bytes: int) -> tuple[pa.Array, np.ndarray]:
    """At most `rows` labelled texts of at most `most_bytes` bytes, in the order of a hash of doc_id, and their labels.

    Ids are chosen on the labels alone; the texts of that bounded set come back through a broadcast of it.
    """
    order = hash_share("doc_id")
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter(learn & F.col("label").isin(0, 1))
    known = known.filter(order < share_for(rows, known.count()))
    ids = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(order, "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= most_bytes)
    found = texts.join(F.broadcast(ids), "doc_id").orderBy(order, "doc_id", "text").limit(rows).select("text", "label").toArrow()
    return found.column("text").combine_chunks(), np.array(found.column("label").to_pylist(), dtype=np.int64)


def classify(docs: DataFrame, model: tuple[np.ndarray, float], s: Settings, threshold: float, scorer=score, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, predicted. The model is one number a bucket, of fixed size."""
    bound_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col), F.col(text_col))
    kind = chosen.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scorer(batch.column(1), *shared.value, s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return chosen.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def fit_quality(docs: DataFrame, labels: DataFrame, learn, s: Settings | None = None, label_col: str = "quality") -> tuple[np.ndarray, float]:
    s = s or Settings()
    return train(*sample(docs, labels, label_col, learn, s.sample_rows, s.sample_bytes), s)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s = table(spark, sf_dir, "documents"), Settings()
    model = fit_quality(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0, s)
    return classify(docs, model, s, 0.3).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
