"""Operator 9, language-model scoring by a weighted backoff automaton.

Tokens are the runs of `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and one end token a text. The model is learned from every
training document: all n-grams of one to three tokens, none left out. A history of c training occurrences, of which c'
go on with w, gives

    p(w | u v) = (c'(u v w) + k3 p(w | v)) / (c(u v) + k3),   p(w | v) = (c'(v w) + k2 p(w)) / (c(v) + k2),

and p(w) = (c(w) + 1) / (N + V + 1), where one share of 1 stands for all unknown words; each history's probabilities sum
to 1. As an automaton (`Automaton`): a state is a history that occurs (no token, one, or two), an arc leaves it for each
n-gram that occurs and weighs log10 p, and a failure arc leads to the history without its first token and weighs
log10(k / (c + k)). A text is read once from left to right: the state is carried on, failure arcs are followed until an
arc takes the token, and the weights are added up. Long texts are read in segments side by side; a segment's first state
is that of the two tokens before it, which is all that a state can hold.

Counts are exact and cover all training text. Texts are written once as blocks of token numbers; blocks send their n-grams'
hashes through `tally` and get their own totals back, and each block builds the part of the automaton that its texts can
reach. No table of the vocabulary is ever broadcast or collected. Words have 64-bit hashes. Longer n-grams are told apart
by `SPARE_BITS` more bits than number the corpus's counted tokens (so that one in some 100,000 meets another), 64 at most.

Defined cases. A null or empty text is the end token alone. A null id is never in the training set (its crc32 is null) and
not held out. Repeated rows count as often as they occur. Without training text every count is 0, every probability 1 and
every score 0. A very long text is a block of its own, its memory a few numbers a token. An empty table gives an empty
result; further columns do not enter it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import bound_batches, buckets_for, crc_mod, cut, give_back, table
from doclens.llm.tally import PART, add_up, by_key, parts, squeeze, totals_in_order, unsqueeze
from doclens.llm.textbytes import mix, pieces, word_hashes

BLOCK = 4 << 20
SPARE_BITS = 18
END, START = np.uint64(0x0E4D), np.uint64(0x57A27)
_PAIR, _TRIPLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


@dataclass(frozen=True)
class Model:
    """Weights of the shorter history (k2, k3), and how many tokens a segment has at most."""

    pair_weight: float = 50.0
    triple_weight: float = 20.0
    segment: int = 64  # two at least


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, end tokens included, and the number of tokens of each row."""
    found, rows = word_hashes(data, offsets)
    words = np.bincount(rows, minlength=len(offsets) - 1)
    return np.insert(found, np.cumsum(words), END), words + 1


def pair_key(before: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Names of pairs of tokens: hashes of the first, mixed hashes of the second."""
    return mix(before * _PAIR + mixed)


def triple_key(pair: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    return mix(pair * _TRIPLE + mixed)


COLUMNS = ["learn", "lengths", "ids", "hashes", "seen"]


def block_row(data: np.ndarray, offsets: np.ndarray, learn: np.ndarray) -> list[bytes]:
    """COLUMNS of the block of these texts."""
    found, lengths = tokens(data, offsets)
    keys, which, counts = np.unique(found, return_inverse=True, return_counts=True)
    rank = np.empty(len(keys), dtype="<u4")
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(keys))
    return [learn.tobytes(), squeeze(lengths.astype("<u4")), squeeze(rank[which]), squeeze(np.diff(keys, prepend=np.uint64(0))), squeeze(counts.astype("<u4"))]


class Block:
    """Documents as numbers: `words` (sorted hashes of distinct tokens), `ids` (the word at each position), lengths, and which documents teach.

    `pairs` and `triples` are the sorted names of the block's distinct n-grams; `pair_at` and `triple_at` tell which one ends at
    each position (triple -1 at a first token).
    """

    def __init__(self, row: dict):
        self.docs = row["docs"]
        self.words = np.cumsum(unsqueeze(row["hashes"], "<u8"), dtype=np.uint64)
        by_count = np.argsort(-unsqueeze(row["seen"], "<u4").astype(np.int64), kind="stable")
        self.ids = by_count[unsqueeze(row["ids"], "<u4")]
        self.lengths = unsqueeze(row["lengths"], "<u4").astype(np.int64)
        self.row_of = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.learn = np.frombuffer(row["learn"], dtype=np.uint8)[self.row_of]
        self.first = np.cumsum(self.lengths) - self.lengths
        mixed = mix(self.words)[self.ids]
        before = np.empty(len(self.ids), dtype=np.uint64)
        before[1:] = self.words[self.ids[:-1]]
        before[self.first] = START
        names = pair_key(before, mixed)
        inner = np.ones(len(self.ids), dtype=bool)
        inner[self.first] = False
        self.inner = np.flatnonzero(inner)
        self.pairs, self.pair_at = np.unique(names, return_inverse=True)
        self.triples, found = np.unique(triple_key(names[self.inner - 1], mixed[self.inner]), return_inverse=True)
        self.triple_at = np.full(len(self.ids), -1)
        self.triple_at[self.inner] = found

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often the training documents hold each word, pair and triple."""
        count = lambda at, learn, n: np.bincount(at, weights=learn, minlength=n).astype(np.int64)
        return count(self.ids, self.learn, len(self.words)), count(self.pair_at, self.learn, len(self.pairs)), count(self.triple_at[self.inner], self.learn[self.inner], len(self.triples))


class Automaton:
    """States, arcs and failure arcs for the n-grams of a block, from their counts in the whole corpus.

    State 0 is the empty history, then come those of one token (the start of a text last) and those of two. State s has
    its `order` and a failure arc to `fail_to[s]` of weight `fail_weight[s]`. `arc_from`, `arc_word`, `arc_weight`, `arc_to`
    hold the arcs: those of the empty history (one a word), then those of pairs, then those of triples that occur.
    """

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, n_all: int, distinct: int, starts: int, model: Model):
        n, k2, k3 = len(block.words), model.pair_weight, model.triple_weight
        p1 = (words + 1) / (n_all + distinct + 1)
        end = block.words == END
        opens = 1 if starts else 0
        single = np.flatnonzero((words > 0) & ~end)
        of_word = np.zeros(n + 1, dtype=np.int64)
        of_word[single] = 1 + np.arange(len(single))
        of_word[n] = self.start = (1 + len(single)) * opens
        # one place at which each pair ends gives its tokens (before: n for the start of a text)
        place = np.empty(len(pairs), dtype=np.int64)
        place[block.pair_at] = np.arange(len(block.ids))
        last = block.ids[place]
        opening = np.zeros(len(block.ids), dtype=bool)
        opening[block.first] = True
        before = np.where(opening[place], n, block.ids[place - 1])
        p2 = (pairs + k2 * p1[last]) / (np.append(words, starts)[before] + k2)
        double = np.flatnonzero((pairs > 0) & ~end[last])
        of_pair = np.zeros(len(pairs), dtype=np.int64)
        of_pair[double] = 1 + len(single) + opens + np.arange(len(double))
        self.order = np.repeat(np.array([0, 1, 2], dtype=np.int8), [1, len(single) + opens, len(double)])
        count = np.concatenate([[0], words[single], [starts] * opens, pairs[double]]).astype(float)
        weight = np.where(self.order == 2, k3, k2)
        self.fail_weight = np.where(self.order > 0, np.log10(weight / (count + weight)), 0.0)
        self.fail_to = np.concatenate([np.zeros(1 + len(single) + opens, dtype=np.int64), of_word[last[double]]])

        place = np.empty(len(triples), dtype=np.int64)
        place[block.triple_at[block.inner]] = block.inner
        left, right = block.pair_at[place - 1], block.pair_at[place]
        p3 = (triples + k3 * p2[right]) / (pairs[left] + k3)
        some2, some3 = np.flatnonzero(pairs > 0), np.flatnonzero(triples > 0)
        # an arc leads to the longest history that is a state; after an end nothing follows
        self.arc_from = np.concatenate([np.zeros(n, dtype=np.int64), of_word[before[some2]], of_pair[left[some3]]])
        self.arc_word = np.concatenate([np.arange(n), last[some2], block.ids[place[some3]]])
        self.arc_weight = np.log10(np.concatenate([p1, p2[some2], p3[some3]]))
        self.arc_to = np.concatenate([of_word[:n], of_pair[some2], of_pair[right[some3]]])
        # the arc that a state of each order has for the token at each position, -1 if none
        arc2, arc3 = np.full(len(pairs), -1), np.full(len(triples) + 1, -1)
        arc2[some2] = n + np.arange(len(some2))
        arc3[some3] = n + len(some2) + np.arange(len(some3))
        self.arc_at = (block.ids, arc2[block.pair_at], arc3[block.triple_at])

    def step(self, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading the tokens at positions `at` from `state`, and the weights of all arcs taken."""
        state, total, arc = state.copy(), np.zeros(len(state)), np.full(len(state), -1)
        for order in (2, 1):
            here = np.flatnonzero((self.order[state] == order) & (arc < 0))
            arc[here] = self.arc_at[order][at[here]]
            here = here[arc[here] < 0]
            total[here] += self.fail_weight[state[here]]
            state[here] = self.fail_to[state[here]]
        arc = np.where(arc < 0, self.arc_at[0][at], arc)
        return self.arc_to[arc], total + self.arc_weight[arc]

    def read(self, block: Block, segment: int) -> np.ndarray:
        """The log10 probability of each document."""
        n = -(-block.lengths // segment)
        row = np.repeat(np.arange(len(n)), n)
        part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begin = block.first[row] + part * segment
        size = np.minimum(segment, block.lengths[row] - part * segment)
        order = np.argsort(-size, kind="stable")
        row, part, begin, size = row[order], part[order], begin[order], size[order]
        state = np.where(part == 0, self.start, 0)
        later = np.flatnonzero(part > 0)
        for back in (2, 1):  # the state of the two tokens before a segment
            state[later] = self.step(state[later], begin[later] - back)[0]
        total = np.zeros(len(row))
        for t in range(int(size[0]) if len(size) else 0):
            own = int(np.searchsorted(-size, -t, "left"))
            state[:own], weight = self.step(state[:own], begin[:own] + t)
            total[:own] += weight
        return np.bincount(row, weights=total, minlength=len(n))


def language_model_scores(docs: DataFrame, learn: Column, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score (unigrams, base 10) and score (the automaton's log10 probability)."""
    model = model or Model()
    spark = docs.sparkSession
    bound_batches(spark)
    chosen = docs.select(F.col(id_col), F.col(text_col), F.coalesce(learn, F.lit(False)).alias("learn"))
    kind = chosen.schema[id_col].dataType.simpleString()
    for_words, for_grams = buckets_for(docs, 32 << 20, 4), buckets_for(docs, 8 << 20)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            teach = np.array(batch.column(2).to_pylist(), dtype=np.uint8)
            for first, data, offsets in pieces(batch.column(1), BLOCK):
                n = len(offsets) - 1
                held = block_row(data, offsets, teach[first : first + n])
                size = int(unsqueeze(held[COLUMNS.index("lengths")], "<u4").sum(dtype=np.int64))
                row = [block, batch.column(0).slice(first, n).to_pylist(), *held, size, int(teach[first : first + n].sum())]
                types = [pa.int64(), pa.list_(batch.schema.types[0]), *[pa.binary()] * 5, pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types, strict=True)], ["block", "docs", *COLUMNS, "n_tokens", "n_learn"])
                block += 1
        give_back()

    blocks = cut(chosen.mapInArrow(first_pass, f"block long, docs array<{kind}>, learn binary, lengths binary, ids binary, hashes binary, seen binary, n_tokens long, n_learn long"), "lm-blocks")
    seen = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_learn"))).first()
    starts, bits = int(seen["n_learn"]), min(64, int(seen["n_tokens"]).bit_length() + SPARE_BITS)
    ranges = [(0, for_words, 64), (for_words, for_grams, bits), (for_words + for_grams, for_grams, bits)]  # first bucket, buckets and bits of words, pairs, triples

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                rows = []
                for keys, counts, (base, n, width) in zip((b.words, b.pairs, b.triples), b.counts(), ranges, strict=True):
                    rows += [(row["block"], base + k, x, c) for k, x, c in parts(keys, counts, n, width)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], ["block", "bucket", "keys", "counts"])
        give_back()

    sent = blocks.select("block", F.lit(None).cast(f"array<{kind}>").alias("docs"), *COLUMNS).mapInArrow(spread, PART)
    totals = cut(add_up(sent, for_words + 2 * for_grams, lambda sums: (sums.sum(), (sums > 0).sum()), "n_sum long, v_sum long", bits=lambda bucket: 64 if bucket < for_words else bits), "lm-totals")
    got = totals.filter((F.col("block") == -1) & (F.col("bucket") < for_words)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_sum", "v_sum"))).first()
    n_all, distinct = int(got["n_sum"]), int(got["v_sum"])

    def last_pass(_: tuple, meta: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        bucket = own.column("bucket")
        words, pairs, triples = (totals_in_order(own.filter(pc.and_(pc.greater_equal(bucket, base), pc.less(bucket, base + n))))[0] for base, n, _ in ranges)
        for row in meta.to_pylist():
            b = Block(row)
            score = Automaton(b, words, pairs, triples, n_all, distinct, starts, model).read(b, model.segment)
            n = len(b.lengths)
            base = np.log10((words + 1) / (n_all + distinct + 1))
            known = np.bincount(b.row_of, weights=words[b.ids] > 0, minlength=n).astype(np.int64)
            kind_of = meta.schema.field("docs").type.value_type
            out.append(pa.table({id_col: pa.array(b.docs, kind_of), "n_tokens": b.lengths, "n_known": known, "train_tokens": np.full(n, n_all), "base_score": np.bincount(b.row_of, weights=base[b.ids], minlength=n), "score": score}))
        return pa.concat_tables(out)  # a block with totals has its documents

    result = f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    back = by_key(totals.filter("block >= 0").select("block", "bucket", "totals"), "block", for_grams)
    return by_key(blocks.drop("n_tokens", "n_learn"), "block", for_grams).groupBy("block").cogroup(back.groupBy("block")).applyInArrow(last_pass, result)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_model_scores(docs, crc_mod("doc_id", 7) != 2)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
