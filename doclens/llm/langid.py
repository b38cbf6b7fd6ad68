"""Operator 2, language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public byte-level vocabulary that consist of letters (or bytes beyond ASCII), lower-case,
with or without the leading space that starts a word. Each language has a probability for every piece, learned by
expectation maximisation on a bounded sample of its texts. A text is scored, language by language, with the forward
algorithm: the probability of a word is the sum over all its segmentations into pieces of the product of their
probabilities; a text's is the product over its words. The words of a block are run through the recursion together in
numpy; equal words are computed once.

Words are runs of ASCII letters and bytes beyond ASCII, lower-cased, each with a leading space. A long run (of a script
without spaces, say) is cut where no piece of the vocabulary reaches across, which leaves its sum over all segmentations as
it is; parts that stay long go through the same recursion in logarithms, byte by byte. Every byte of the vocabulary is a
piece, so every word has a segmentation.

Each language is learned in a task of its own; the driver holds the finished model, one number a piece and language.

Defined cases. A null text, or one without a letter, is `und` with score 0. Null languages are not learned from; without
any learned language every text is `und`. Ties go to the language that sorts first. Rows are scored one by one, so
repeated rows, null ids and further columns change nothing; an empty table gives an empty result. A very long text is read
in parts that end between words.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from doclens.llm.common import bound_batches, crc_mod, cut, hash_share, keep_rows, share_for, table
from doclens.llm.textbytes import BASE, BYTE_CODE, column_bytes, mix, powers, prefix_hash, ranges, rows_within, span_hash, spans

BLOCK = 1 << 20
#: Words of up to so many bytes are run together, in plain probabilities; how many at once.
WORD, TOGETHER = 31, 1 << 15
VOCABULARY = "byte_bpe_50k.tiktoken"
_NOT_LETTER = np.ones(256, dtype=bool)
_NOT_LETTER[97:123] = False
_NOT_LETTER[128:] = False
_LOG2_SLOTS = 18


@dataclass(frozen=True)
class Settings:
    """`sample_rows` distinct texts a language are learned from, or all it has. Texts of more than `sample_bytes` bytes come last and count with that many bytes.
    A text is foreign to a language if its log probability a byte is lower by `margin` than that of 99 % of the texts learned from."""

    sample_rows: int = 400
    sample_bytes: int = 20_000
    rounds: int = 4
    floor: float = 1e-7
    margin: float = 1.5


class Pieces:
    """Hashes of the vocabulary's usable pieces in an open-addressed table; `sizes` are the lengths that occur."""

    def __init__(self, path: str | None = None):
        import public_tokenizers

        found = [base64.b64decode(line.split()[0]) for line in open(path or public_tokenizers.path(VOCABULARY), "rb") if line.strip()]
        body = lambda p: p[1:] if p[:1] == b" " else p
        usable = sorted({p for p in found if len(p) == 1 or (body(p) and not any(_NOT_LETTER[b] for b in body(p)))} | {bytes([b]) for b in range(256)})
        self.sizes = sorted({len(p) for p in usable})
        self.hashes = np.array([_hash(p) for p in usable], dtype=np.uint64)
        self.slots = np.full(1 << _LOG2_SLOTS, -1, dtype=np.int32)
        for k, h in enumerate(self.hashes.tolist()):
            at = h >> (64 - _LOG2_SLOTS)
            while self.slots[at] >= 0:
                at = (at + 1) & ((1 << _LOG2_SLOTS) - 1)
            self.slots[at] = k

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        at = (hashes >> np.uint64(64 - _LOG2_SLOTS)).astype(np.int64)
        out = self.slots[at]
        wrong = np.flatnonzero((out >= 0) & (self.hashes[out] != hashes))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << _LOG2_SLOTS) - 1)
            out[wrong] = self.slots[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.hashes[out[wrong]] != hashes[wrong])]
        return out


def _hash(piece: bytes) -> int:
    total = sum(int(BYTE_CODE[b]) * pow(BASE, i, 1 << 64) for i, b in enumerate(piece)) + len(piece)
    return int(mix(np.array([total & ((1 << 64) - 1)], dtype=np.uint64))[0])


def hits(vocabulary: Pieces, text: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends, sizes and numbers of all pieces in text, in order of end; none crosses from one run (a number a byte) to the next."""
    prefix, found = prefix_hash(text), []
    for n in vocabulary.sizes:
        if n <= len(text):
            start = np.flatnonzero(run[: len(text) - n + 1] == run[n - 1 :])
            piece = vocabulary.find(span_hash(prefix, start, start + n))
            hit = np.flatnonzero(piece >= 0)
            found.append((start[hit] + n, np.full(len(hit), n), piece[hit]))
    ends, sizes, pieces = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(ends, kind="stable")
    return ends[order], sizes[order], pieces[order]


def words_of(vocabulary: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes, leading spaces (1 or 0) and rows of the words of lower-cased texts, long runs cut where no piece reaches across."""
    starts, ends, rows = spans(data, offsets, _NOT_LETTER)
    sizes, lead = ends - starts, np.ones(len(starts), dtype=np.int64)
    long = np.flatnonzero(sizes > WORD)
    if not len(long):
        return starts, sizes, lead, rows
    # the long runs end to end, each with its space
    whole = sizes[long] + 1
    first = np.cumsum(whole) - whole
    run = np.repeat(np.arange(len(long)), whole)
    at = np.arange(len(run)) - first[run] - 1  # byte of the run, -1 for the space
    text = np.where(at < 0, np.uint8(32), data[np.maximum(starts[long][run] + at, 0)])
    stop, n, _ = hits(vocabulary, text, run)
    across = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(across, stop - n + 1, 1)
    np.add.at(across, stop, -1)
    cut = np.flatnonzero((np.cumsum(across)[: len(text)] == 0) | (at < 0))  # no piece covers both this byte and the one before
    size = np.diff(np.append(cut, len(text)))
    of, spaced = long[run[cut]], (at[cut] < 0).astype(np.int64)
    short = np.flatnonzero(sizes <= WORD)
    parts = (starts[of] + np.maximum(at[cut], 0), size - spaced, spaced, rows[of])
    return tuple(np.concatenate([a[short], b]) for a, b in zip((starts, sizes, lead, rows), parts, strict=True))


class Lattice:
    """The segmentations of distinct words (with a space before the first byte where `lead` is 1).

    Those of up to WORD + 1 bytes lie in `text`, a column each, longest first; longer ones have their pieces listed in `long`.
    """

    def __init__(self, vocabulary: Pieces, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lead: np.ndarray):
        whole = sizes + lead
        self.n = len(whole)
        self.order = np.argsort(-whole, kind="stable")
        self.order = self.order[whole[self.order] <= WORD + 1]
        sizes = whole[self.order]
        self.sizes = sizes
        width = int(sizes[0]) if len(sizes) else 0
        text = np.full((width, len(sizes)), 32, dtype=np.uint8)
        begin, spaced = starts[self.order], lead[self.order]
        for k in range(width):
            own = np.flatnonzero((sizes > k) & (k >= spaced))
            text[k, own] = data[begin[own] + k - spaced[own]]
        self.steps: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        code = BYTE_CODE[text]
        up, _ = powers(width + 1)
        for end in range(1, width + 1):
            own = int(np.searchsorted(-sizes, -end, "right"))  # words of at least `end` bytes
            for n in vocabulary.sizes:
                if n > end:
                    break
                total = np.full(own, n, dtype=np.uint64)
                for k in range(n):
                    total += code[end - n + k, :own] * up[k]
                found = vocabulary.find(mix(total))
                hit = np.flatnonzero(found >= 0)
                if len(hit):
                    self.steps.append((end, n, hit, found[hit]))
        self.width = width
        self.long = []
        for k in np.flatnonzero(whole > WORD + 1).tolist():
            own = np.concatenate([np.full(lead[k], 32, dtype=np.uint8), data[starts[k] : starts[k] + whole[k] - lead[k]]])
            self.long.append((k, len(own), *hits(vocabulary, own, np.zeros(len(own), dtype=np.int64))))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(width + 1, words, languages): probability of the first `i` bytes of each word, over all segmentations."""
        a = np.zeros((self.width + 1, len(self.sizes), p.shape[1]))
        a[0] = 1
        for end, n, hit, found in self.steps:
            a[end, hit] += a[end - n, hit] * p[found]
        return a

    @staticmethod
    def _log_forward(size: int, ends: np.ndarray, sizes: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """(size + 1, languages): log of the same for one long word; log_p has a row a hit."""
        a = np.zeros((size + 1, log_p.shape[1]))
        at = np.searchsorted(ends, np.arange(size + 2))
        for end in range(1, size + 1):
            own = slice(at[end], at[end + 1])
            each = a[end - sizes[own]] + log_p[own]
            top = each.max(axis=0)
            a[end] = top + np.log(np.exp(each - top).sum(axis=0))
        return a

    def logs(self, p: np.ndarray) -> np.ndarray:
        """(words, languages): log probability of each word, in the order in which the words were given."""
        a = self.forward(p)
        out = np.empty((self.n, p.shape[1]))
        out[self.order] = np.log(a[self.sizes, np.arange(len(self.sizes))])
        for k, size, ends, sizes, found in self.long:
            out[k] = self._log_forward(size, ends, sizes, np.log(p[found]))[size]
        return out

    def expected(self, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (p: pieces x 1) when each word occurs `weights` times."""
        a = self.forward(p)[:, :, 0]
        n = len(self.sizes)
        whole = a[self.sizes, np.arange(n)]
        b = np.zeros_like(a)
        b[self.sizes, np.arange(n)] = weights[self.order] / whole
        out = np.zeros(len(p))
        for end, size, hit, found in reversed(self.steps):
            through = b[end, hit] * p[found, 0]
            b[end - size, hit] += through
            out += np.bincount(found, weights=through * a[end - size, hit], minlength=len(p))
        for k, size, ends, sizes, found in self.long:
            log_p = np.log(p[found])
            ahead = self._log_forward(size, ends, sizes, log_p)[:, 0]
            back = np.argsort(-(ends - sizes), kind="stable")  # the same recursion from the other side
            behind = self._log_forward(size, size - (ends - sizes)[back], sizes[back], log_p[back])[:, 0]
            out += np.bincount(found, weights=weights[k] * np.exp(ahead[ends - sizes] + log_p[:, 0] + behind[size - ends] - ahead[size]), minlength=len(p))
        return out


def _distinct(vocabulary: Pieces, column: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, list[Lattice], np.ndarray, np.ndarray, np.ndarray]]:
    """Of parts of the texts: first row, number of rows, lattices of the distinct words, their sizes, and for every word its row and which one it is."""
    data, offsets = column_bytes(pc.utf8_lower(column.fill_null("")))
    for at, to in ranges(data, offsets, _NOT_LETTER, block):
        part = data[at:to]
        first, own = rows_within(offsets, at, to)
        starts, sizes, lead, rows = words_of(vocabulary, part, own)
        if len(starts):
            keys = span_hash(prefix_hash(part), starts, starts + sizes) ^ lead.astype(np.uint64)
            _, one, which = np.unique(keys, return_index=True, return_inverse=True)
            groups = [one[k : k + TOGETHER] for k in range(0, len(one), TOGETHER)]
            yield first, len(own) - 1, [Lattice(vocabulary, part, starts[g], sizes[g], lead[g]) for g in groups], (sizes + lead)[one], rows, which


class Identifier:
    def __init__(self, languages: list[str], p: np.ndarray, least: np.ndarray, path: str | None):
        self.languages, self.p, self.least, self.path = languages, p, least, path

    def identify(self, column: pa.Array, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1: und), its share of the texts' probability, and whether the text fits it: log probability a byte of `least` or more."""
        n, k = len(column), len(self.languages)
        if not k:
            return np.full(n, -1), np.zeros(n), np.zeros(n, dtype=bool)
        total, size = np.zeros((n, k)), np.zeros(n)
        for first, count, lattices, sizes, rows, which in _distinct(vocabulary, column):
            logs = np.concatenate([lattice.logs(self.p) for lattice in lattices])
            size[first : first + count] += np.bincount(rows, weights=sizes[which].astype(float), minlength=count)
            for j in range(k):
                total[first : first + count, j] += np.bincount(rows, weights=logs[which, j], minlength=count)
        letters = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
        best = total.argmax(axis=1)
        fits = letters & (total.max(axis=1) >= self.least[best] * size)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return np.where(letters, best, -1), np.where(letters, share, 0.0), fits


def _sample(usable: DataFrame, s: Settings) -> DataFrame:
    """lang, th of min(sample_rows, all) distinct texts of every language of usable (lang, th, long): the first by hash, long texts after all others."""
    spark = usable.sparkSession
    order = [F.col("long"), hash_share("th"), F.col("th")]

    def first(rows: DataFrame) -> DataFrame:
        ranked = rows.groupBy("lang", "th", "long").count().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        return cut(ranked.filter(F.col("r") <= s.sample_rows).select("lang", "th"), "sampled")

    # Copies share one hash, so the share in which texts are sought is that of distinct texts.
    there = usable.groupBy("lang").agg(F.approx_count_distinct(F.when(~F.col("long"), F.col("th"))).alias("short"), F.count_if("long").alias("longs")).collect()  # one row a language
    shares = {r["lang"]: share_for(s.sample_rows, r["short"]) for r in there}
    limits = spark.createDataFrame(list(shares.items()), "lang string, share double")
    chosen = first(usable.join(F.broadcast(limits), "lang").filter(~F.col("long") & (hash_share("th") < F.col("share"))))
    found = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}
    lacking = [(r["lang"],) for r in there if found.get(r["lang"], 0) < s.sample_rows and (shares[r["lang"]] < 1 or r["longs"])]
    if lacking:  # few distinct texts of the usual length, or an estimate too high: all texts of these languages are ranked
        names = F.broadcast(spark.createDataFrame(lacking, "lang string"))
        chosen = chosen.join(names, "lang", "left_anti").unionByName(first(usable.join(names, "lang")))
    return chosen


def learn_one(vocabulary: Pieces, texts: pa.Array, s: Settings) -> tuple[np.ndarray, float]:
    """Of one language: the probability of every piece, and the least log probability a byte of a text that fits."""
    n = len(vocabulary.hashes)
    q = np.full((n, 1), 1 / n)
    known = [(first, lattices, sizes, rows, which, np.bincount(which, minlength=len(sizes)).astype(float)) for first, _, lattices, sizes, rows, which in _distinct(vocabulary, texts)]
    for _ in range(s.rounds):
        used = np.zeros(n)
        for _, lattices, _, _, _, weights in known:
            at = 0
            for lattice in lattices:
                used += lattice.expected(q, weights[at : at + lattice.n])
                at += lattice.n
        q = (np.maximum(used / max(used.sum(), 1.0), s.floor))[:, None]
        q /= q.sum()
    own, size = np.zeros(len(texts)), np.zeros(len(texts))
    for first, lattices, sizes, rows, which, _ in known:
        logs = np.concatenate([lattice.logs(q)[:, 0] for lattice in lattices])
        own += np.bincount(first + rows, weights=logs[which], minlength=len(texts))
        size += np.bincount(first + rows, weights=sizes[which].astype(float), minlength=len(texts))
    return q[:, 0], float(np.quantile(own[size > 0] / size[size > 0], 0.01) - s.margin) if size.any() else -np.inf


def learn_languages(docs: DataFrame, learn: Column, s: Settings | None = None, path: str | None = None, text_col: str = "text", lang_col: str = "lang") -> Identifier:
    """Piece probabilities of every language of the learning rows, on at most `sample_rows` of its texts, in hash order."""
    s = s or Settings()
    lang, th, text = F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("th"), F.col(text_col)
    long = F.octet_length(text) > s.sample_bytes
    head = F.rtrim(F.make_valid_utf8(F.substring(text.cast("binary"), 1, s.sample_bytes).cast("string")), F.lit("\ufffd"))
    known = docs.filter(learn & F.col(lang_col).isNotNull() & text.isNotNull())
    usable = known.select(lang, th, long.alias("long"))
    chosen = F.broadcast(_sample(usable, s))  # sample_rows a language
    texts = known.select(lang, th, F.when(long, head).otherwise(text).alias("text"))
    found = texts.join(chosen, ["lang", "th"]).groupBy("lang", "th").agg(F.min("text").alias("text")).select("lang", "th", "text")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        q, least = learn_one(Pieces(path), group.sort_by("th").column("text").combine_chunks(), s)
        return pa.table({"lang": [key[0].as_py()], "p": pa.array([q.astype("<f8").tobytes()], pa.binary()), "least": [least]})

    bound_batches(docs.sparkSession)
    models = sorted(found.groupBy("lang").applyInArrow(run, "lang string, p binary, least double").collect(), key=lambda r: r["lang"])  # a row of fixed size a language
    p = np.stack([np.frombuffer(r["p"], dtype="<f8") for r in models], axis=1) if models else np.zeros((0, 0))
    return Identifier([r["lang"] for r in models], p, np.array([r["least"] for r in models]), path)


def identify(docs: DataFrame, model: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score."""
    bound_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col), F.col(text_col))
    kind = chosen.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x pieces of a fixed vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces(shared.value.path)
        for batch in batches:
            best, share, _ = shared.value.identify(batch.column(1), vocabulary)
            names = pa.array([*shared.value.languages, "und"])
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(np.where(best < 0, len(names) - 1, best))), pa.array(share)], [id_col, "lang_pred", "score"])

    return chosen.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Identifier, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows with a language of at least `min_score` that fit it, with all their columns; `und` and texts foreign to all languages go."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def build():
        vocabulary = Pieces(shared.value.path)

        def keep(column: pa.Array) -> pa.Array:
            best, share, fits = shared.value.identify(column, vocabulary)
            return pa.array((best >= 0) & (share >= min_score) & fits)

        return keep

    return keep_rows(docs, text_col, build)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_languages(docs, crc_mod("doc_id", 3) != 1)
    return identify(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
