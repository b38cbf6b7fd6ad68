"""Operator 6, bounded-space online packing into windows of a fixed number of tokens.

Each partition is read once, in order. It holds at most `open_windows` windows: full windows of a long document go out by
themselves, the remainder goes to the open window that it fills best, and when none has room the fullest one is emitted.
With `fill`, the emitted window first takes the head of the waiting piece, so that it is full. At its end a partition
merges its open windows until one remains; the ones of up to `merge_partitions` partitions are then merged the same way.
Only the last window of such a group can be short. The first pass is written to the shared folder, so each document is
tokenised once and a lost executor repeats only its own partitions.

Token ids come from a public vocabulary file (never trained here), special tokens not added, followed by `end_id`.
Texts are tokenised by runs of characters that this vocabulary never joins; runs seen before come from a cache of bounded
size that ends with its task.

Defined cases. A null or empty text is the end id alone. Null and repeated ids are carried along as they are: each row is
a document of its own. Further columns do not enter the result. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import bound_batches, cut, give_back, table
from doclens.llm.textbytes import pieces

VOCABULARY = "word_bpe_49k.json"


@dataclass(frozen=True)
class Packing:
    size: int = 2048
    open_windows: int = 16
    end_id: int = 1
    fill: bool = True
    merge_partitions: int = 256
    cached_words: int = 200_000


_LETTER, _SIGN, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[97:123] = _LETTER
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = _SIGN


def runs(text: bytes) -> list[bytes]:
    """Parts that this vocabulary never joins: cut at ASCII white space and between an ASCII letter and an ASCII sign.

    A-Z are lower-cased, as the vocabulary does. Apostrophes stay with their neighbours.
    """
    text = text.lower()
    kind = _KIND[np.frombuffer(text, dtype=np.uint8)]
    at = np.flatnonzero((kind[1:] ^ kind[:-1] == _LETTER ^ _SIGN) & (kind[1:] != 0) & (kind[:-1] != 0)) + 1
    return (np.insert(np.frombuffer(text, dtype=np.uint8), at, 32).tobytes() if len(at) else text).split()


#: How byte-level vocabularies spell bytes: printable ones as themselves, the others from code point 256 on.
_SPELT = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
_BYTE_AS = {b: chr(b) for b in _SPELT} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_SPELT))}


class _Generation(dict):
    """Ids of runs seen; a run that is new here is looked for in the generation before, then tokenised."""

    def __init__(self, tokenizer, before: dict):
        super().__init__()
        self.tokenizer, self.model, self.before = tokenizer, tokenizer.model, before

    def __missing__(self, run: bytes) -> bytes:
        found = self.before.get(run)
        if found is None:
            text = run.decode("utf-8", "replace")
            ids = [t.id for t in self.model.tokenize(spelt)] if (spelt := _spelling(text)) else self.tokenizer.encode(text, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        self[run] = found
        return found


def _spelling(text: str) -> str | None:
    """A run of Latin letters as the vocabulary's model takes it, past normaliser and splitter, which leave it whole."""
    if text.isalpha():
        if text.isascii():
            return text
        if max(text) < "\u0250" and (text := text.lower()).isalpha():
            return "".join(_BYTE_AS[b] for b in text.encode())
    return None


_tokenizers: dict[str, object] = {}


def _tokenizer(path: str | None):
    """The vocabulary, read once a worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path(VOCABULARY)
    return _tokenizers.get(path) or _tokenizers.setdefault(path, Tokenizer.from_file(path))


class Encoder:
    """Token ids of UTF-8 texts as little-endian 32-bit bytes. Two generations of about `cached_words` runs each are remembered."""

    def __init__(self, path: str | None, cached_words: int):
        self.tokenizer = _tokenizer(path)
        self.most, self.known = cached_words, _Generation(self.tokenizer, {})

    def block(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.before = {}
            self.known = _Generation(self.tokenizer, dict(self.known))
        get = self.known.__getitem__
        return [self._whole(t) if b"<|" in t else b"".join(map(get, runs(t))) for t in texts]

    def _whole(self, text: bytes) -> bytes:
        """Of a text that may spell a special token, which is sought before anything else."""
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


@dataclass
class Window:
    used: int
    parts: list[tuple]


class Packer:
    """Places pieces (document, start, ids as bytes, tokens of the document); hands each full window to `emit`."""

    def __init__(self, how: Packing, emit):
        self.how, self.emit, self.open = how, emit, []

    def add(self, doc, ids: bytes) -> None:
        total, at, size = len(ids) // 4, 0, self.how.size
        while total - at >= size:
            self.emit([(doc, at, ids[4 * at : 4 * (at + size)], total)])
            at += size
        while at < total:
            at += self._place(doc, at, ids, total)

    def _place(self, doc, at: int, ids: bytes, total: int) -> int:
        rest, size = total - at, self.how.size
        fits = [w for w in self.open if size - w.used >= rest]
        if fits:
            into = max(fits, key=lambda w: w.used)
        elif len(self.open) < self.how.open_windows:
            into = Window(0, [])
            self.open.append(into)
        else:
            into = max(self.open, key=lambda w: w.used)
            if not self.how.fill:
                self._close(into)
                return 0
            rest = size - into.used
        into.parts.append((doc, at, ids[4 * at : 4 * (at + rest)], total))
        into.used += rest
        if into.used == size:
            self._close(into)
        return rest

    def _close(self, window: Window) -> None:
        self.open = [w for w in self.open if w is not window]
        self.emit(window.parts)

    def leftovers(self) -> list[tuple]:
        """The pieces of the open windows, fullest first, once all full windows that they make were emitted."""
        rest = [part for w in sorted(self.open, key=lambda w: -w.used) for part in w.parts]
        self.open = []
        return merge(rest, self.how.size, self.emit)


def merge(parts: list[tuple], size: int, emit) -> list[tuple]:
    """Cuts pieces, end to end, into full windows; returns the pieces that are left, fewer than a window's tokens."""
    held, used = [], 0
    for doc, start, ids, total in parts:
        at, n = 0, len(ids) // 4
        while at < n:
            take = min(n - at, size - used)
            held.append((doc, start + at, ids[4 * at : 4 * (at + take)], total))
            at, used = at + take, used + take
            if used == size:
                emit(held)
                held, used = [], 0
    return held


_FIELDS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open", "ids"]
_TYPES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, ids binary"


class _Rows:
    """Rows of windows on their way out; ids are kept for open windows and where the caller wants them."""

    def __init__(self, id_col: str, id_type: pa.DataType, first_sequence: int, keep_ids: bool):
        self.names, self.id_type, self.keep = [id_col, *_FIELDS], id_type, keep_ids
        self.next, self.columns = first_sequence, [[] for _ in range(9)]

    def window(self, parts: list[tuple], still_open: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in parts:
            row = (doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, offset, still_open, ids if still_open or self.keep else None)
            for column, value in zip(self.columns, row, strict=True):
                column.append(value)
            offset += len(ids) // 4
        self.next += 1

    def take(self, at_least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) > at_least:
            types = [self.id_type, *[pa.int64()] * 6, pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, types, strict=True)], self.names)
            self.columns = [[] for _ in range(9)]


def pack(docs: DataFrame, how: Packing | None = None, tokenizer_path: str | None = None, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with keep_ids, ids (binary, '<u4')."""
    how = how or Packing()
    spark = docs.sparkSession
    bound_batches(spark)
    chosen = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    kind = chosen.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {_TYPES}"
    end = np.array([how.end_id], dtype="<u4").tobytes()

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, rows, packer = Encoder(tokenizer_path, how.cached_words), None, None
        for batch in batches:
            if packer is None:
                rows = _Rows(id_col, batch.schema.types[0], TaskContext.get().partitionId() << 36, keep_ids)
                packer = Packer(how, rows.window)
            ids = batch.column(0).to_pylist()
            for first, data, offsets in pieces(batch.column(1), 1 << 20):
                whole = data.tobytes()
                at = offsets.tolist()
                for k, found in enumerate(encoder.block([whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])):
                    packer.add(ids[first + k], found + end)
                yield from rows.take(20_000)
        if packer is not None:
            if rest := packer.leftovers():
                rows.window(rest, still_open=True)
            yield from rows.take()
        del encoder
        give_back()

    done = cut(chosen.mapInArrow(first_pass, schema), "packed")

    def merged(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        parts = list(zip(group.column(id_col).to_pylist(), group.column("start").to_pylist(), group.column("ids").to_pylist(), group.column("doc_tokens").to_pylist(), strict=True))
        rows = _Rows(id_col, group.schema.field(id_col).type, (1 << 62) | (key[0].as_py() << 36), keep_ids)
        if rest := merge(parts, how.size, rows.window):
            rows.window(rest)
        return pa.Table.from_batches(rows.take(-1))

    group = F.floor(F.shiftright("sequence_id", 36) / how.merge_partitions).cast("long")
    last = done.filter("open").withColumn("merge_group", group).groupBy("merge_group").applyInArrow(merged, schema)
    out = done.filter("not open").unionByName(last).drop("open")
    return out if keep_ids else out.drop("ids")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep_ids=False)
