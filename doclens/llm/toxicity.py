"""Operator 4, toxicity by a character n-gram linear classifier with naive Bayes log-count ratios.

Features are the distinct hashed character n-grams of a document: of the bytes of its UTF-8, A-Z lower-cased, all but letters
and digits read as a space. A character beyond ASCII thus fills two or more places of an n-gram. Of the held-out rows 68 of 70
are right at sf0.01, 805 of 825 at sf0.1 and all 4,061 at check_s; counted in code points, with the same lengths, 65, 814 and
4,060. Each is scaled by its naive Bayes log-count ratio between the classes, and a logistic layer over the
scaled features is trained in numpy on a bounded sample of labelled rows with an L1 step, so that most weights end at 0.

The layer's size is a parameter: of the features of `least_documents` documents of the sample, or more, it takes the
`candidates` for which the documents that have them times what their ratio exceeds `least_ratio` by is largest. That is a
choice of features, on the sample; no row or text is left out by it. All features that occur twice take some six times as
long to train; with n-grams of code points they get 64, 816 and 4,058 of the same rows right, and none of the 6 toxic ones of
sf0.01.
Scoring hashes every n-gram of the whole text and sums the distinct features that have a weight.

Defined cases. A null or empty text has no features: its score is what the bias gives. Without a labelled row of either
class every score is the share of label 1 (0.5 without any). Null labels are not learned from. Rows are scored one by
one, so repeated rows, null ids and further columns change nothing; an empty table gives an empty result. Texts of more
than `BLOCK` bytes are read in parts cut at white space, and a feature still counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import crc_mod, table
from doclens.llm.subword import classify, sample
from doclens.llm.textbytes import LOWER, NOT_WORD, column_bytes, cut_long, pieces

BLOCK = 1 << 19
_FOLD = LOWER.copy()
_FOLD[NOT_WORD[LOWER]] = 32
_CODES = np.random.Generator(np.random.PCG64(19)).integers(1, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)
_STEPS = [np.uint32(pow(0x85EBCA6B, k + 1, 1 << 32)) for k in range(16)]


@dataclass(frozen=True)
class Settings:
    """`sample_rows` and `sample_bytes` bound the labelled sample: so many rows at most, none of a longer text. The others are above."""

    buckets_log2: int = 20
    ngrams: tuple[int, ...] = (4, 5, 6)
    smoothing: float = 1.0
    candidates: int = 4000
    least_documents: int = 3
    least_ratio: float = 0.7
    steps: int = 150
    rate: float = 0.05
    l1: float = 5e-5
    sample_rows: int = 4000
    sample_bytes: int = 20_000


def ngrams(data: np.ndarray, offsets: np.ndarray, s: Settings) -> list[tuple[np.ndarray, int]]:
    """(bucket of the n-gram at each position, n) for each n. Positions whose n-gram crosses rows are for the caller to drop."""
    code = _CODES[_FOLD[data]]
    rolled, out = np.zeros(len(data), dtype=np.uint32), []
    for k in range(max(s.ngrams)):
        size = max(0, len(data) - k)
        rolled = rolled[:size] + code[k : k + size] * _STEPS[k]
        if k + 1 in s.ngrams:
            out.append((((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - s.buckets_log2), k + 1))
    return out


def distinct(data: np.ndarray, offsets: np.ndarray, s: Settings, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of the distinct features of each row, of those that `wanted` (a table over buckets) marks."""
    row_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    keys = []
    for found, n in ngrams(data, offsets, s):
        at = np.arange(len(found)) if wanted is None else np.flatnonzero(wanted[found])
        at = at[row_of[at] == row_of[at + n - 1]]
        keys.append(row_of[at] << s.buckets_log2 | found[at])
    whole = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
    return whole >> s.buckets_log2, (whole & ((1 << s.buckets_log2) - 1)).astype(np.int64)


def log_count_ratios(texts: pa.Array, labels: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Documents with each feature, by class, and the smoothed log ratio of its shares in the classes."""
    size = 1 << s.buckets_log2
    counts = np.zeros((2, size), dtype=np.int32)
    for first, data, offsets in pieces(texts, BLOCK):
        rows, buckets = distinct(data, offsets, s)
        of = labels[first + rows]
        for y in (0, 1):
            counts[y] += np.bincount(buckets[of == y], minlength=size).astype(np.int32)
    rates = (counts + s.smoothing) / (counts + s.smoothing).sum(axis=1, keepdims=True)
    ratio = np.log(rates[1] / rates[0])
    return counts, ratio


def train(texts: pa.Array, labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weights by bucket and bias: the log-odds of class 1 are bias + the sum of the weights of a document's distinct features."""
    size = 1 << s.buckets_log2
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(size, dtype=np.float32), float(np.log(share / (1 - share)))
    counts, ratio = log_count_ratios(texts, labels, s)
    held = counts.sum(axis=0)
    gain = np.maximum(np.abs(ratio) - s.least_ratio, 0) * held
    chosen = np.sort(np.argsort(-gain, kind="stable")[: s.candidates])
    chosen = chosen[held[chosen] >= s.least_documents]
    place = np.full(size, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    row_parts, column_parts = [], []
    for first, data, offsets in pieces(texts, BLOCK):
        rows, buckets = distinct(data, offsets, s, place >= 0)
        row_parts.append((first + rows).astype(np.int32))
        column_parts.append(place[buckets])
    rows, columns = np.concatenate(row_parts), np.concatenate(column_parts)
    scale, n = ratio[chosen], len(labels)
    x = scale[columns]
    w, bias = np.zeros(len(chosen)), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, s.steps + 1):
        z = np.bincount(rows, weights=w[columns] * x, minlength=n) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels) / n
        gw, gb = np.bincount(columns, weights=g[rows] * x, minlength=len(w)), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        a, b = 1 - 0.9**step, 1 - 0.999**step
        size_of = s.rate / (np.sqrt(v / b) + 1e-8)
        w = w - size_of * m / a
        w = np.sign(w) * np.maximum(np.abs(w) - size_of * s.l1, 0)
        bias -= s.rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    out = np.zeros(size, dtype=np.float32)
    out[chosen] = w * scale
    return out, float(bias)


def score(column: pa.Array, weights: np.ndarray, bias: float, s: Settings) -> np.ndarray:
    data, offsets = column_bytes(column)
    parts, part_row = cut_long(data, offsets, BLOCK)
    n, wanted = len(offsets) - 1, weights != 0
    keys, first = [np.zeros(0, dtype=np.int64)], 0
    while first < len(part_row):
        last = max(first + 1, int(np.searchsorted(parts, parts[first] + BLOCK, "right")) - 1)
        own = parts[first : last + 1]
        rows, buckets = distinct(data[own[0] : own[-1]], own - own[0], s, wanted)
        keys.append(part_row[first:last][rows] << s.buckets_log2 | buckets)
        first = last
    whole = np.unique(np.concatenate(keys))
    total = np.bincount(whole >> s.buckets_log2, weights=weights[whole & ((1 << s.buckets_log2) - 1)], minlength=n)
    return 1 / (1 + np.exp(-np.clip(total + bias, -60, 60)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn, s: Settings | None = None, label_col: str = "toxic") -> tuple[np.ndarray, float]:
    s = s or Settings()
    return train(*sample(docs, labels, label_col, learn, s.sample_rows, s.sample_bytes), s)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s = table(spark, sf_dir, "documents"), Settings()
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0, s)
    return classify(docs, model, s, 0.5, score).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
