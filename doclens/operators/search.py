"""Ranked search by cosine similarity over a weighted index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions.text import preview
from doclens.operators.tfidf import Vectorizer, counted_ids, fitted, postings, vector_rows, weighted
from doclens.session import cut, hold

#: Queries from which a search multiplies matrices; documents and queries of a group, and queries of a partition of them.
MANY, DOCS_GROUP, QUERIES_GROUP, QUERIES_SIDE = 16, 1024, 512, 1024


class SearchIndex:
    """Weights of a corpus before their norm (doc_id, term, weight), norms (doc_id, norm), the idf of its terms, and its
    documents (doc_id, class, path, text).

    A search of few queries takes the weights of its queries' terms and the norms of the documents that have one. `save` writes the
    weights of each partition sorted by term, so that a query's terms prune pages; they are not shuffled for it.

    Many queries meet nearly all documents, so the pairs are not made rows: packed groups of documents and of queries meet as a
    product of partitions, a matrix product finds the candidates in single precision, their similarities are then computed in
    double, and a task keeps the k best of each query. Of equal documents in a group the k of the smallest ids stay.
    """

    def __init__(self, weights: DataFrame, norms: DataFrame, idf: DataFrame, docs: DataFrame, vectorizer: Vectorizer, rows: Callable[[list[str]], DataFrame] | None = None):
        self.weights, self.norms, self.idf, self.docs, self.vectorizer = weights, norms, idf, docs, vectorizer
        self.rows = rows or (lambda known: _collected(weights, known, "doc_id", "weight"))

    @classmethod
    def build(cls, docs: DataFrame, terms: Column, vectorizer: Vectorizer | None = None) -> SearchIndex:
        vectorizer = vectorizer or Vectorizer()
        n, repeat = counted_ids(docs)
        idf = hold(fitted(docs, terms, vectorizer, n, repeat))
        weights = weighted(docs, terms, replace(vectorizer, l2=False), idf, repeat)
        norms = weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
        return cls(weights, norms, idf, docs, vectorizer, None if repeat else lambda known: vector_rows(docs, terms, replace(vectorizer, l2=False), idf, known))

    def save(self, path: str) -> None:
        write = lambda rows, name: rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        write(self.weights.sortWithinPartitions("term", "doc_id"), "weights")
        write(self.norms, "norms")
        write(self.idf, "idf")
        write(self.docs.select("doc_id", "class", "path", "text"), "docs")

    @classmethod
    def load(cls, spark, path: str, vectorizer: Vectorizer | None = None) -> SearchIndex:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(read("weights"), read("norms"), read("idf"), read("docs"), vectorizer or Vectorizer())

    def search(self, queries: DataFrame, terms: Column, k: int = 5) -> DataFrame:
        """query_id, rank, doc_id, class, path, similarity (rounded to 6 digits, above 0), preview of the k best documents a query."""
        asked = postings(queries.select(F.col("query_id").alias("doc_id"), terms.alias("__terms")), F.col("__terms"))
        vectors = self.vectorizer.transform(asked, self.idf).select(F.col("doc_id").alias("query_id"), "term", F.col("weight").alias("q"))
        kinds = dict(self.docs.dtypes)["doc_id"], dict(queries.dtypes)["query_id"]
        if all(kind in ("tinyint", "smallint", "int", "bigint") for kind in kinds) and queries.count() >= MANY:
            ranked = self._best_of_many(vectors, k).select(F.col("query_id").cast(kinds[1]).alias("query_id"), F.col("doc_id").cast(kinds[0]).alias("doc_id"), "similarity", "rank")
        else:
            ranked = self._best_of_few(vectors, k)
        return F.broadcast(ranked).join(self.docs, "doc_id").select("query_id", "rank", "doc_id", "class", "path", "similarity", preview(F.col("text")).alias("preview"))

    def _best_of_few(self, vectors: DataFrame, k: int) -> DataFrame:
        hits = hold(self.weights.join(F.broadcast(vectors), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("q")).alias("dot")))
        norms = self.norms.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
        return _ranked(hits.join(norms, "doc_id").select("query_id", "doc_id", (F.col("dot") / F.col("norm")).alias("similarity")), k)

    def _best_of_many(self, vectors: DataFrame, k: int) -> DataFrame:
        known = sorted(r["term"] for r in self.idf.select("term").collect())  # max_features
        asked = _packed(_collected(hold(vectors), known, "query_id", "q"), "asked", QUERIES_GROUP)
        asked = cut(asked.withColumn("name", F.expr("uuid()")), "asked")
        sides = max(1, -(-(asked.agg(F.sum(F.size("asked_ids"))).first()[0] or 0) // QUERIES_SIDE))
        docs = cut(_packed(self.rows(known), "docs", DOCS_GROUP, k), "docs")
        pairs = docs.hint("shuffle_replicate_nl").crossJoin(asked.repartition(sides, "name"))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_, last = {}, None
            for batch in batches:
                for row in range(batch.num_rows):
                    name = batch.column("name")[row].as_py()
                    if name not in open_:
                        open_[name] = _Best(_Sparse.of(batch, row, "asked"), len(known), k)
                    first = batch.column("docs_ids")[row].values[0].as_py()
                    if last is None or last[0] != first:
                        docs = _Sparse.of(batch, row, "docs").normalised()
                        last = first, docs, docs.dense(len(known), np.float32)
                    open_[name].look(*last[1:])
            yield from (b.rows() for b in open_.values())

        return _ranked(pairs.mapInArrow(compare, "query_id long, doc_id long, similarity double"), k)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, similarity (rounded, above 0), rank of the k best a query."""
    rounded = scores.withColumn("similarity", F.round("similarity", 6)).filter("similarity > 0")
    return rounded.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id"))).filter(F.col("rank") <= k)


def _collected(weights: DataFrame, known: list[str], key: str, value: str) -> DataFrame:
    """key, at, x: the places in `known` of a key's terms, ascending, and their weights."""
    places = F.broadcast(weights.sparkSession.createDataFrame([(t, n) for n, t in enumerate(known)], "term string, place int"))
    found = weights.join(places, "term").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", F.col(value).alias("v")))).alias("m"))
    return found.select(key, F.col("m.place").alias("at"), F.col("m.v").alias("x"))


@dataclass
class _Sparse:
    """Rows of a sparse matrix: their ids, where each begins, and the columns and values."""

    ids: np.ndarray
    begins: np.ndarray
    at: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, row: int, name: str) -> _Sparse:
        ids, sizes = (batch.column(f"{name}_{c}")[row].values.to_numpy() for c in ("ids", "sizes"))
        at, x = (np.frombuffer(batch.column(f"{name}_{c}")[row].as_buffer(), dtype=kind) for c, kind in (("at", np.int32), ("x", np.float64)))
        return cls(ids, np.r_[0, np.cumsum(sizes)], at, x)

    def of_rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.begins))

    def normalised(self) -> _Sparse:
        of = self.of_rows()
        return _Sparse(self.ids, self.begins, self.at, self.x / np.sqrt(np.bincount(of, weights=self.x * self.x, minlength=len(self.ids)))[of])

    def dense(self, width: int, kind: type) -> np.ndarray:
        out = np.zeros((len(self.ids), width), dtype=kind)
        out[self.of_rows(), self.at] = self.x
        return out


class _Best:
    """The k best documents so far of a group of queries."""

    def __init__(self, asked: _Sparse, width: int, k: int):
        self.ids, self.k, self.x = asked.ids, k, asked.dense(width, np.float64)
        self.small = self.x.astype(np.float32)
        self.margin = 2e-5 * np.maximum(1, np.sqrt((self.x * self.x).sum(axis=1)))
        self.s, self.doc = np.zeros((len(self.ids), k)), np.full((len(self.ids), k), np.iinfo(np.int64).max)

    def look(self, docs: _Sparse, dense: np.ndarray) -> None:
        rough = self.small @ dense.T
        least = (self.s[:, -1] - self.margin).astype(np.float32)
        hit = (rough >= least[:, None]) & (rough > 0)
        if np.count_nonzero(hit) > 4 * self.k * len(self.ids) and len(docs.ids) > self.k:
            best = -np.partition(-rough, self.k - 1, axis=1)[:, self.k - 1]
            hit &= rough >= (best - 2 * self.margin).astype(np.float32)[:, None]
        q, j = np.nonzero(hit)
        for part in range(0, len(q), 1 << 14):
            self._add(q[part : part + (1 << 14)], j[part : part + (1 << 14)], docs)

    def _add(self, q: np.ndarray, j: np.ndarray, docs: _Sparse) -> None:
        size = docs.begins[j + 1] - docs.begins[j]
        ends = np.cumsum(size)
        flat = np.arange(ends[-1]) + np.repeat(docs.begins[j] - (ends - size), size)
        of = np.repeat(np.arange(len(j)), size)
        exact = np.bincount(of, weights=self.x[q[of], docs.at[flat]] * docs.x[flat], minlength=len(j))
        met = np.unique(q)
        group = np.concatenate([np.repeat(met, self.k), q])
        s, doc = np.concatenate([self.s[met].ravel(), exact]), np.concatenate([self.doc[met].ravel(), docs.ids[j]])
        order = np.lexsort((doc, -np.floor(s * 1e6 + 0.5), group))
        best = order[(np.searchsorted(group[order], met)[:, None] + np.arange(self.k)).ravel()].reshape(len(met), self.k)
        self.s[met], self.doc[met] = s[best], doc[best]

    def rows(self) -> pa.RecordBatch:
        q, place = np.nonzero(self.s > 0)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q].astype(np.int64)), pa.array(self.doc[q, place].astype(np.int64)), pa.array(self.s[q, place])], ["query_id", "doc_id", "similarity"])


def _packed(rows: DataFrame, name: str, most: int, k: int | None = None) -> DataFrame:
    """Groups of at most `most` consecutive rows (id, at, x) that have a term; of more than k equal ones in a group the k of the smallest ids stay."""
    key = rows.columns[0]

    def pack(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        met: dict[tuple, int] = {}
        kept = []
        for r in sorted(rows, key=lambda r: r[0]):
            met[r[1:]] = met.get(r[1:], 0) + 1
            if k is None or met[r[1:]] <= k:
                kept.append(r)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        joined = [pa.array([b"".join(r[c] for r in kept)], pa.binary()) for c in (1, 2)]
        return pa.RecordBatch.from_arrays([one([r[0] for r in kept], pa.int64()), one([len(r[1]) // 4 for r in kept], pa.int32()), *joined], [f"{name}_{c}" for c in ("ids", "sizes", "at", "x")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, bytes, bytes]] = []
        for batch in batches:
            at, x = batch.column("at"), batch.column("x")
            starts, ends = at.offsets.to_numpy()[:-1], at.offsets.to_numpy()[1:]
            places, values = at.values.to_numpy(), x.values.to_numpy()
            shift = x.offsets.to_numpy()[0] - starts[0] if len(starts) else 0
            for id_, a, b in zip(batch.column(0).to_pylist(), starts.tolist(), ends.tolist(), strict=True):
                if b > a and id_ is not None:
                    waiting.append((id_, places[a:b].tobytes(), values[a + shift : b + shift].tobytes()))
                    if len(waiting) == most:
                        yield pack(waiting)
                        waiting = []
        if waiting:
            yield pack(waiting)

    return rows.select(F.col(key).cast("long").alias("id"), "at", "x").mapInArrow(run, f"{name}_ids array<long>, {name}_sizes array<int>, {name}_at binary, {name}_x binary")
