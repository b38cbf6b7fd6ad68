"""Operator 10, quality rules by repetition coverage.

Word n-grams of several lengths are hashed with a rolling combination in numpy; within each text, the characters (code
points) of the words inside n-grams seen before, and inside lines seen before, are measured against all of them.

Defined cases. A null or empty text has no words: every count is 0, coverages are 0 and the base rule fails it. Rows are
judged one by one, so repeated rows, null ids and further columns of any name change nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from doclens.llm.common import bound_batches, keep_rows, table
from doclens.llm.textbytes import mix, pieces, sums, window_hash, words

BLOCK = 1 << 20
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[10] = True
_ROW = np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Rules:
    """Largest share of a text's word characters inside repeated n-grams (by n) and repeated lines, and of symbols a word."""

    coverage: dict[int, float] = field(default_factory=lambda: dict.fromkeys(range(5, 11), 0.3))
    line_coverage: float = 0.3
    symbols_per_word: float = 0.1
    min_words: int = 50
    repeat_percent: int = 50


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more; whether it has occurred earlier."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1] if len(keys) else False
    often, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    often[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return often, later


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    edge = np.zeros(size + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    hashes, starts, ends, rows = words(data, offsets, fold=False)
    count = np.int32 if len(data) < 1 << 31 else np.int64
    points = np.zeros(len(data) + 1, dtype=count)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    out = {"n_words": np.bincount(rows, minlength=n).astype(np.int64), "word_chars": sums(chars, rows, n)}
    symbols = np.zeros(len(data) + 1, dtype=count)
    np.cumsum(SYMBOL[data], out=symbols[1:])
    out["n_symbols"] = (symbols[offsets[1:]] - symbols[offsets[:-1]]).astype(np.int64)

    lines, first, last, of = words(data, offsets, NEWLINE, fold=False)
    words_to = np.searchsorted(starts, last)
    words_from = np.searchsorted(starts, first)
    spoken = words_to > words_from
    lines, of, words_from, words_to = lines[spoken], of[spoken], words_from[spoken], words_to[spoken]
    _, later = _again(mix(lines ^ (of.astype(np.uint64) * _ROW)))
    out["n_dup_lines"] = sums(later, of, n)
    total = np.concatenate([[0], np.cumsum(chars)])
    in_lines = sums((total[words_to] - total[words_from]) * later, of, n)
    whole = np.maximum(out["word_chars"], 1)
    out["line_coverage"] = in_lines / whole

    salt = rows.astype(np.uint64) * _ROW
    size = len(starts)
    triples = max(0, size - 2)
    valid = np.flatnonzero(rows[:triples] == rows[2 : 2 + triples])
    often, _ = _again(mix(window_hash(hashes, 3)[valid] ^ salt[valid]))
    seeds = valid[often]  # a longer n-gram that repeats starts with three words that do
    out["n_repeat_words"] = sums(_covered(seeds, 3, size), rows, n)
    at, keys = seeds, np.zeros(len(seeds), dtype=np.uint64)
    for k in range(1, max(rules.coverage, default=0) + 1):
        fits = np.flatnonzero(at + k <= size)
        fits = fits[rows[at[fits]] == rows[at[fits] + k - 1]]
        at = at[fits]
        keys = mix(keys[fits] + hashes[at + k - 1])  # the hash rolls on from that of k - 1 words
        if k not in rules.coverage:
            continue
        _, later = _again(keys ^ salt[at])
        out[f"coverage_{k}"] = sums(chars * _covered(at[later], k, size), rows, n) / whole
    failed = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.repeat_percent * out["n_words"])
    bad = (out["line_coverage"] > rules.line_coverage) | (out["n_symbols"] > rules.symbols_per_word * out["n_words"])
    for k, most in rules.coverage.items():
        bad |= out[f"coverage_{k}"] > most
    return out | {"base_failed": failed, "kept": ~failed & ~bad}


def _measured(column: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    parts = [measure(data, offsets, rules) for _, data, offsets in pieces(column, BLOCK)] or [measure(np.zeros(0, np.uint8), np.zeros(1, np.int64), rules)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def repetition_report(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, counts, coverages and verdict of each row."""
    rules = rules or Rules()
    chosen = docs.select(id_col, text_col)
    kind = chosen.schema[id_col].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["line_coverage", *(f"coverage_{k}" for k in rules.coverage)]
    schema = f"{id_col} {kind}, " + ", ".join([*(f"{c} long" for c in counts), "base_failed boolean", "kept boolean", *(f"{c} double" for c in shares)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _measured(batch.column(1), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[c]) for c in [*counts, "base_failed", "kept", *shares])], [id_col, *counts, "base_failed", "kept", *shares])

    bound_batches(docs.sparkSession)
    return chosen.mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: Rules | None = None, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    rules = rules or Rules()
    bound_batches(docs.sparkSession)
    return keep_rows(docs, text_col, lambda: lambda column: pa.array(_measured(column, rules)["kept"]))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_report(table(spark, sf_dir, "documents"))


def _op10_sql(rules: Rules) -> str:
    def again(n: int) -> str:
        return f"(SELECT doc_id, n AS n, sum(c) AS covered FROM (SELECT DISTINCT doc_id, {n} AS n, unnest(range(i, i + {n})) AS i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS r FROM (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM t))) WHERE r > 1) JOIN c USING (doc_id, i) GROUP BY doc_id, n)"

    share = lambda x: f"coalesce({x}, 0) / greatest(word_chars, 1)::DOUBLE"
    covers = ", ".join(f"{share(f'c{k}')} AS coverage_{k}" for k in rules.coverage)
    bad = " OR ".join(f"coverage_{k} > {m}" for k, m in rules.coverage.items())
    words = r"'[^\x20\x09-\x0D]+'"
    return f"""
WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {words}) AS w FROM documents),
c AS MATERIALIZED (SELECT doc_id, generate_subscripts(w, 1) AS i, len(unnest(w)) AS c FROM t),
v AS ({" UNION ALL ".join(again(k) for k in rules.coverage)}),
pv AS (SELECT doc_id, {", ".join(f"max(covered) FILTER (n = {k}) AS c{k}" for k in rules.coverage)} FROM v GROUP BY doc_id),
g3 AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM g3 QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY j) AS r FROM (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS j FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM t)) WHERE regexp_matches(line, {words})),
dl AS (SELECT doc_id, count(*) AS n, sum(list_sum(list_transform(regexp_extract_all(line, {words}), lambda x: len(x)))) AS chars FROM ln WHERE r > 1 GROUP BY doc_id),
b AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce((SELECT sum(c) FROM c WHERE c.doc_id = t.doc_id), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, dl.chars AS line_chars FROM t LEFT JOIN dl USING (doc_id) LEFT JOIN rep USING (doc_id)),
m AS (SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {share("line_chars")} AS line_coverage, {covers}
  FROM b LEFT JOIN pv ON pv.doc_id = b.doc_id),
f AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (line_coverage > {rules.line_coverage} OR n_symbols > {rules.symbols_per_word} * n_words OR {bad}) AS kept FROM f
"""


OP10_SQL = _op10_sql(Rules())
