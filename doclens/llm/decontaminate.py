"""Operator 5, benchmark decontamination by one Aho-Corasick automaton.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased. Each item gives its windows of `window`
words (an item of fewer gives one window); all windows of all items enter one automaton, whose symbols are the benchmark's
words, and each text is scanned once as a sequence of such symbols, whose places lead back to the original. No occurrence
crosses a word that no window has, so what is walked are the runs between such words, as far as a window fits in. Words are
told apart by 64-bit hashes.

The automaton goes to every worker, so its size is checked: windows of more than `limit` states in all are dealt into groups
by hash, and the texts pass one automaton after the other, spans accumulating in a column that is written in between, with the
same result: a worker holds one automaton and the driver one broadcast at a time. An automaton holds the number of each window's set of items; the items themselves, however many share a window, are joined to the texts found.

Defined cases. A null or empty text has no words: nothing is hit and it is not contaminated; a null or wordless item has
no windows. Windows of an item with a null item_id hit words but name no item. Items that share an id count once. An empty
benchmark hits nothing. Rows are judged one by one, so repeated rows, null ids and further columns change nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from doclens.llm.common import bound_batches, cut, discard, look_up, table
from doclens.llm.textbytes import LOWER, NOT_WORD, column_bytes, pieces, words

BLOCK = 1 << 20
#: States of one automaton, some 64 bytes each.
STATES = 1 << 21
_APART = NOT_WORD[LOWER]
_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def windows_of(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """key (the window's words between spaces), n_words, items (the sorted distinct ids, as text, of the items that have it)."""
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words_of = benchmark.select(F.col("item_id").cast("string").alias("item"), F.regexp_extract_all(lowered, F.lit(f"({_CLASS})"), 1).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = words_of.select("item", "w", F.explode(starts).alias("at")).select("item", F.array_join(F.slice("w", F.col("at"), window), " ").alias("key"), F.least(F.size("w"), F.lit(window)).alias("n_words"))
    return each.groupBy("key", "n_words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Machine:
    """An automaton over the words of `keys`; a match gives the number of words and the number of the window's set of items."""

    def __init__(self, keys: list[str], sets: list[int]):
        import ahocorasick

        split = [k.split(" ") for k in keys]
        known = sorted({w for k in split for w in k})
        data, offsets = column_bytes(pa.array(known, pa.string()))
        hashes = words(data, offsets, _APART)[0]
        order = np.argsort(hashes)
        self.hashes, self.symbols = hashes[order], order + 1
        symbol = {w: k + 1 for k, w in enumerate(known)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, of in zip(split, sets, strict=True):
            self.automaton.add_word(tuple(symbol[w] for w in k), (len(k), of))
        self.shortest = min(map(len, split), default=0)
        if keys:
            self.automaton.make_automaton()

    def read(self, hashes: np.ndarray) -> np.ndarray:
        """The symbols of words, 0 for those that no window has."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.symbols[at], 0)

    def hits(self, symbols: np.ndarray) -> list[tuple[int, int, int]]:
        """(first word, word after the last, set) of every occurrence of a window in a text."""
        if not self.shortest:
            return []
        gaps = np.concatenate([[-1], np.flatnonzero(symbols == 0), [len(symbols)]])
        long_enough = np.flatnonzero(np.diff(gaps) > self.shortest)
        found = []
        for a, b in zip((gaps[long_enough] + 1).tolist(), gaps[long_enough + 1].tolist(), strict=True):
            found += [(a + end + 1 - n, a + end + 1, of) for end, (n, of) in self.automaton.iter(tuple(symbols[a:b].tolist()))]
        return found


_machines: dict[str, Machine] = {}


def _machine(name: str, shared) -> Machine:
    """The automaton of a broadcast; a worker keeps the one that it used last."""
    if name not in _machines:
        _machines.clear()
        _machines[name] = Machine(*shared.value)
    return _machines[name]


def _merged(found: list[tuple[int, int, int]]) -> tuple[list[int], list[int], list[int]]:
    spans_of: list[list[int]] = []
    for a, b, _ in sorted(found):
        if spans_of and a <= spans_of[-1][1]:
            spans_of[-1][1] = max(spans_of[-1][1], b)
        else:
            spans_of.append([a, b])
    return [a for a, _ in spans_of], [b for _, b in spans_of], sorted({s for _, _, s in found})


def _groups(windows: DataFrame, limit: int) -> list[DataFrame]:
    total = windows.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // limit))
    return [windows] if n == 1 else [windows.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == k) for k in range(n)]


_RESULT = "word_from array<int>, word_to array<int>, char_from array<int>, char_to array<int>, n_words long, sets array<long>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, limit: int = STATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the merged hit spans as word and as character ranges of the original text, n_words and the items found."""
    windows = cut(windows_of(benchmark, window).withColumn("set", F.xxhash64("items")), "windows")
    found = cut(_scan(docs.select(F.col(id_col), F.col(text_col)), windows, limit, text_col).drop(text_col), "scanned")
    none, hit = found.filter(F.size("sets") == 0), found.filter(F.size("sets") > 0)
    kinds = cut(hit.groupBy("sets").agg(F.count(F.lit(1)).alias("held")), "kinds")  # texts that met the same windows
    items = windows.groupBy("set").agg(F.any_value("items").alias("items"))
    named = kinds.select("sets", F.explode("sets").alias("set")).join(items, "set").groupBy("sets").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    total = kinds.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    facts = cut(kinds.join(named, "sets"), "kinds")
    listed = look_up(hit, facts, "sets", int(total))
    return none.withColumn("items", F.array().cast("array<string>")).unionByName(listed).drop("sets")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, limit: int = STATES, text_col: str = "text") -> DataFrame:
    """The rows in which no window of the benchmark occurs, with all their columns."""
    names = [f.name for f in docs.schema]
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("held"), F.col(f"`{text_col}`").alias("text"))
    windows = cut(windows_of(benchmark, window).withColumn("set", F.xxhash64("items")), "windows")
    clean = _scan(held, windows, limit, "text").filter(F.size("word_from") == 0)
    return clean.select(*(F.col(f"held.`{c}`").alias(c) for c in names))


def _scan(rows: DataFrame, windows: DataFrame, limit: int, text_col: str) -> DataFrame:
    bound_batches(rows.sparkSession)
    names = rows.columns
    at = names.index(text_col)
    out, groups, before = rows, _groups(windows, limit), None
    for k, group in enumerate(groups):
        found = group.select("key", "set").collect()  # windows of `limit` words together
        shared = rows.sparkSession.sparkContext.broadcast(([r["key"] for r in found], [r["set"] for r in found]))
        out = out.mapInArrow(_scanner(uuid.uuid4().hex, shared, at, len(names), first=k == 0), _with_result(rows.schema))
        if k + 1 < len(groups):  # the next automaton begins when this one is done with
            out = cut(out, "scanned")
            shared.destroy()
            if before is not None:
                discard(before)
            before = out
    return out


def _with_result(schema: StructType) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(_RESULT).fields])


def _scanner(name: str, shared, at: int, width: int, first: bool):
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(name, shared)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            old = None if first else [batch.column(width + k).to_pylist() for k in (0, 1, 5)]
            row = 0
            for _, data, offsets in pieces(batch.column(at), BLOCK):
                hashes, starts, ends, rows = words(data, offsets, _APART)
                symbols = machine.read(hashes)
                to = np.searchsorted(rows, np.arange(len(offsets)))
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    found = machine.hits(symbols[to[k] : to[k + 1]])
                    if old and old[0][row]:  # the spans that an automaton before found, and its sets on a span of no words
                        x, y, sets = (column[row] for column in old)
                        found = [*found, *((a, b, sets[0]) for a, b in zip(x, y, strict=True)), *((x[0], x[0], s) for s in sets)]
                    lo, hi, sets = _merged(found) if found else ([], [], [])
                    chars = [[], []]
                    if lo:
                        points = np.concatenate([[0], np.cumsum((data[a:b] & 0xC0) != 0x80)])
                        chars = [points[starts[to[k] + np.array(lo)] - a].tolist(), points[ends[to[k] + np.array(hi) - 1] - a].tolist()]
                    for column, value in zip(out, [lo, hi, *chars, int(to[k + 1] - to[k]), sets], strict=True):
                        column.append(value)
                    row += 1
            arrays = [*(batch.column(k) for k in range(width)), *(pa.array(c, ints) for c in out[:4]), pa.array(out[4], pa.int64()), pa.array(out[5], longs)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:width], "word_from", "word_to", "char_from", "char_to", "n_words", "sets"])

    return run


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("word_from", "word_to", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("word_from") > 0).alias("contaminated"))


OP5_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
