"""Operator 12, periodic runs of words.

Every distinct word of a text gets a number, exactly (no hashes); then, level by level, every window of 2**k words gets a
name from the names of its two halves (Karp, Miller and Rosenberg), so that equal names mean equal windows. How far two
places agree is found by descending the levels, repeating one while it agrees, so names take a fixed number of bytes a word.

A run of period q has at least 4q words, so some multiple of q lies among its first q words, and what follows there agrees
with what follows q words on for more than 2q words: one comparison of names a grid point leaves few candidates, which are
extended both ways. Periods are taken in ascending order; a candidate inside a run found earlier has that run's period.

Many texts are worked on together, longest first, so that for each period only the texts long enough for it are looked at.

Defined cases. A null or empty text has no words: no run, four nulls, and the hashes of empty strings. A null id has no
decimal, so its text is not edited. Rows are judged one by one: ties, repeated rows and further columns change nothing; an
empty table gives an empty result. A long text is a block of its own, of some 250 bytes a word; nothing is cut short.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from doclens.llm.common import bound_batches, give_back, table
from doclens.llm.textbytes import SPACE, pieces, spans

BLOCK = 1 << 20
#: Windows of at most 2**TOP words are named.
TOP = 13


@dataclass(frozen=True)
class RunRule:
    """A run has at least `least` words and `times` periods (four or more, on which the search relies)."""

    least: int = 6
    times: int = 4


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=at[1:])
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    letters = np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _name(keys: np.ndarray, where: np.ndarray, size: int) -> np.ndarray:
    """Names of `size` places: equal for equal keys at the places `where`; a key that occurs once, and every other place, has a name of its own, below 0."""
    out = -1 - np.arange(size, dtype=np.int64)
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    often = counts[which] > 1
    out[where[often]] = which[often]
    return out.astype(np.int32) if size < 1 << 31 else out


def names(numbers: np.ndarray, texts: np.ndarray, sizes: np.ndarray, rule: RunRule, top: int) -> list[np.ndarray]:
    """Names of the windows of 2**k words by k, from the words' numbers and texts. Texts are in descending order of size.

    A window's first word bears its text, so windows of different texts differ, and so do those that reach over an end
    unless they are the same. Only texts that can hold two windows a period apart are named at a level.
    """
    base = int(numbers.max(initial=0)) + 1
    out = [_name(texts * base + numbers, np.arange(len(numbers)), len(numbers))]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    for k in range(1, top + 1):
        half, long_enough = 1 << (k - 1), int(np.count_nonzero(sizes >= max(rule.least, 2 << k)))
        size = int(upto[long_enough]) - (1 << k) + 1
        if size <= 0:
            break
        left, right = out[-1][:size].astype(np.int64), out[-1][half : half + size].astype(np.int64)
        where = np.flatnonzero((left >= 0) & (right >= 0))
        out.append(_name(left[where] * (len(numbers) + 1) + right[where], where, size))
    return out


def _agree(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False, most: int | None = None) -> np.ndarray:
    """How many words from places a and b on agree (or, with back, before them; then at least `most` says enough).

    A level may be taken several times, as the highest ones have no names in short texts.
    """
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level, width = levels[k], 1 << k
        open_ = np.arange(len(a))
        while len(open_):
            x, y = (a[open_] - out[open_] - width, b[open_] - out[open_] - width) if back else (a[open_] + out[open_], b[open_] + out[open_])
            fits = (x >= 0) & (y < len(level))
            same = np.zeros(len(open_), dtype=bool)
            same[fits] = level[x[fits]] == level[y[fits]]
            open_ = open_[same]
            out[open_] += width
            if most is not None:
                open_ = open_[out[open_] < most]
    return out


def runs_of(numbers: np.ndarray, texts: np.ndarray, sizes: np.ndarray, rule: RunRule | None = None, top: int = TOP) -> np.ndarray:
    """Rows (start, length, period) of all runs of texts that lie end to end in descending order of size."""
    rule = rule or RunRule()
    levels = names(numbers, texts, sizes, rule, top)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.repeat(upto[1:], sizes)
    reach = np.zeros(len(numbers), dtype=np.int64)  # the farthest end of a run found so far over each word
    found = [np.zeros((0, 3), dtype=np.int64)]
    for q in range(1, int(sizes.max(initial=0)) // rule.times + 1):
        size = int(upto[np.count_nonzero(sizes >= max(rule.least, rule.times * q))])
        level = levels[min(len(levels) - 1, (2 * q).bit_length() - 1)]
        size = min(size, len(level))
        if size <= q:
            break
        near, far = level[: size - q : q], level[q:size:q]
        at = np.flatnonzero(near == far) * q
        at = at[(at + 3 * q < ends[at]) & (reach[at] < at + 3 * q)]
        if not len(at):
            continue
        before = _agree(levels, at, at + q, back=True, most=q)
        at, before = at[before < q], before[before < q]
        length = before + q + _agree(levels, at, at + q)
        good = length >= max(rule.least, rule.times * q)
        rows = np.stack([(at - before)[good], length[good], np.full(int(good.sum()), q)], axis=1)
        rows = rows[reach[rows[:, 0]] < rows[:, 0] + rows[:, 1]]
        for start, words, _ in rows.tolist():
            np.maximum(reach[start : start + words], start + words, out=reach[start : start + words])
        found.append(rows)
    return np.concatenate(found)


def edit_places(doc_id: object, n: int) -> np.ndarray | None:
    """Which original word stands at each place of an edited text; None where the text stays as it is."""
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n, dtype=np.int64)
    places[a:] = a + (places[a:] - a) % p
    return places


def _hash_of_words(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """Of the words joined by one space, a part at a time."""
    out, data = hashlib.sha256(), text.tobytes()
    for k in range(0, len(starts), 1 << 16):
        part = b" ".join([data[a:b] for a, b in zip(starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist(), strict=True)])
        out.update(b" " + part if k else part)
    return out.hexdigest()


REPORT = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def report(data: np.ndarray, offsets: np.ndarray, ids: list, rule: RunRule | None = None, edit: bool = True) -> list[list]:
    """The columns REPORT of texts that lie end to end."""
    starts, ends, rows = spans(data, offsets, SPACE)
    n = len(offsets) - 1
    first = np.searchsorted(rows, np.arange(n + 1))
    numbers, sizes = word_numbers(data, starts, ends), np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    places = [edit_places(ids[r], int(sizes[r])) if edit else None for r in range(n)]
    own = [numbers[first[r] : first[r + 1]] if places[r] is None else numbers[first[r] : first[r + 1]][places[r]] for r in order]
    sorted_sizes = sizes[order]
    runs = runs_of(np.concatenate(own) if own else numbers, np.repeat(np.arange(n), sorted_sizes), sorted_sizes, rule)
    upto = np.concatenate([[0], np.cumsum(sorted_sizes)])
    of = np.searchsorted(upto, runs[:, 0], "right") - 1
    by_text: dict[int, list] = {}
    for k, (start, length, period) in zip(of.tolist(), runs.tolist(), strict=True):
        by_text.setdefault(int(order[k]), []).append((start - int(upto[k]), length, period))
    out = []
    for r in range(n):
        a, b = starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]]
        if places[r] is not None:
            a, b = a[places[r]], b[places[r]]
        got = sorted(by_text.get(r, ()), key=lambda x: (x[0], x[2]))
        best = [None] * 4
        if got:
            kept = np.ones(len(a), dtype=bool)
            top = got[0]
            for start, length, period in got:
                kept[start + period : start + length] = False
                if length * top[2] > top[1] * period:  # exact; ties stay with the smaller start, then period
                    top = (start, length, period)
            a, b = a[kept], b[kept]
            best = [*top, 1000 * top[1] // top[2]]
        said = "".join(f"{s},{w},{p}\n" for s, w, p in got)
        out.append([len(got), *best, hashlib.sha256(said.encode()).hexdigest(), _hash_of_words(data[offsets[r] : offsets[r + 1]], a - offsets[r], b - offsets[r])])
    return out


def periodic_runs(docs: DataFrame, rule: RunRule | None = None, edit: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and REPORT for each row: its runs, the strongest one, and hashes of the runs and of the words that remain once every run is cut to its first period."""
    chosen = docs.select(id_col, text_col)
    kind = chosen.schema[id_col].dataType.simpleString()
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for at, data, offsets in pieces(batch.column(1), BLOCK):
                rows += report(data, offsets, ids[at : at + len(offsets) - 1], rule, edit)
            columns = list(zip(*rows, strict=True)) or [()] * len(REPORT)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [id_col, *REPORT])
        give_back()

    bound_batches(docs.sparkSession)
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), edit=True)


OP12_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, doc_id::VARCHAR AS k FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h FROM t),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
w AS MATERIALIZED (SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word FROM (SELECT doc_id, w, n, a, p, unnest(range(n)) AS i FROM p)),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM island GROUP BY doc_id, start, length),
s AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM run GROUP BY doc_id),
top AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DECIMAL(18, 0) / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM (SELECT * FROM w ANTI JOIN gone USING (doc_id, i)) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM t LEFT JOIN s USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
