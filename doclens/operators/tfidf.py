"""Vocabularies, term weights and their statistics as long tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.operators.joins import null_safe_join
from doclens.operators.numbering import numbered
from doclens.session import cut


def postings(docs: DataFrame, terms: Column, *keep: str) -> DataFrame:
    """doc_id, kept columns, term, tf: one row a distinct term of a document."""
    return docs.select("doc_id", *keep, F.explode(terms).alias("term")).groupBy("doc_id", *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def document_count(post: DataFrame) -> int:
    """Documents with a term. A document's rows of post lie together after their grouping, so few ids are shuffled."""
    return post.agg(F.countDistinct("doc_id")).first()[0]


def vocabulary(df: DataFrame, n_docs: int, min_df: int = 2, max_df_ratio: float = 0.95) -> DataFrame:
    """term, df of the band min_df <= df <= int(n_docs * max_df_ratio)."""
    return df.filter(F.col("df").between(min_df, int(n_docs * max_df_ratio)))


def with_term_ids(vocab: DataFrame) -> DataFrame:
    """term_id: the place of the term in sorted order, from counts of the terms that begin with the same three bytes."""
    found = numbered(vocab, ["term"], F.substring(F.col("term").cast("binary"), 1, 3), name="term_id")
    return found.withColumn("term_id", F.col("term_id") - 1)


def top_terms_by_count(post: DataFrame, n: int) -> DataFrame:
    """term, df, total of the n terms with the largest corpus count; ties by term."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(n)


def idf_log10(df: Column, n_docs: int) -> Column:
    return F.log10(F.lit(float(n_docs)) / F.greatest(df, F.lit(1))) + 1


def idf_plain(df: Column, n_docs: Column | int) -> Column:
    return F.log(_of(n_docs).cast("double") / df) + 1


def idf_smooth(df: Column, n_docs: Column | int) -> Column:
    return F.log((_of(n_docs) + 1).cast("double") / (df + 1)) + 1


def _of(n: Column | int) -> Column:
    return F.lit(n) if isinstance(n, int) else n


def course_tfidf(post: DataFrame, vocab: DataFrame, n_docs: int) -> DataFrame:
    """tf * (log10(N / df) + 1) over a document-frequency band; no normalisation."""
    return post.join(vocab.select("term", idf_log10(F.col("df"), n_docs).alias("idf")), "term").withColumn("tfidf", F.col("tf") * F.col("idf"))


@dataclass(frozen=True)
class Vectorizer:
    """A library-style vectoriser: most frequent terms, optional sublinear tf and smoothing, optional L2 norm."""

    max_features: int = 5000
    sublinear: bool = True
    smooth: bool = True
    l2: bool = True

    def fit(self, post: DataFrame, n_docs: int) -> DataFrame:
        """term, idf."""
        idf = idf_smooth if self.smooth else idf_plain
        return top_terms_by_count(post, self.max_features).select("term", idf(F.col("df"), n_docs).alias("idf"))

    def transform(self, post: DataFrame, idf: DataFrame) -> DataFrame:
        """doc_id, kept columns, term, weight."""
        tf = 1 + F.log("tf") if self.sublinear else F.col("tf")
        out = post.join(idf, "term").withColumn("weight", tf * F.col("idf")).drop("tf", "idf")
        if self.l2:
            norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("doc_id")))
            out = out.withColumn("weight", F.col("weight") / norm)
        return out


# ---- weights inside the rows of documents ------------------------------------------------------------------------


def counted_ids(docs: DataFrame) -> tuple[int, bool]:
    """The number of rows, and whether several have one doc_id (null is one)."""
    found = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    return found["rows"], found["most"] > 1


def _counted(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of arrays of terms: its distinct terms, and by row and distinct term of the row the row's number, the term's and how often it is there."""
    coded = column.flatten().dictionary_encode()
    row, code = pc.list_parent_indices(column).to_numpy(), coded.indices.to_numpy()
    size = max(1, len(coded.dictionary))
    places, tf = np.unique(row.astype(np.int64) * size + code, return_counts=True)
    return coded.dictionary, places // size, places % size, tf


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def term_counts(docs: DataFrame, terms: Column, among: list[str] | None = None) -> DataFrame:
    """term, df, total of documents of which each is one row: rows count their own terms, so postings are neither shuffled nor held. Of the terms of `among` alone where given."""
    held = None if among is None else docs.sparkSession.sparkContext.broadcast(pa.array(among, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2048):
            found = _slice_counts(batch.column("__t"))
            yield found if held is None else found.filter(pc.is_in(found.column("term"), value_set=held.value))

    return docs.select(terms.alias("__t")).mapInArrow(run, _COUNTS).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


_COUNTS = "term string, df long, total long"


def _slice_counts(column: pa.Array) -> pa.RecordBatch:
    known, _, code, tf = _counted(column)
    counts = np.bincount(code, minlength=len(known)).astype(np.int64), np.bincount(code, weights=tf, minlength=len(known)).astype(np.int64)
    return pa.RecordBatch.from_arrays([known.cast(pa.string()), *map(pa.array, counts)], ["term", "df", "total"])


def row_postings(docs: DataFrame, terms: Column) -> DataFrame:
    """doc_id, term, tf of documents of which each is one row: what postings finds, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            known, row, code, tf = _counted(batch.column("__t"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), known.cast(pa.string()).take(pa.array(code)), pa.array(tf.astype(np.int64))], ["doc_id", "term", "tf"])

    return docs.select("doc_id", terms.alias("__t")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, term string, tf long")


#: Distinct terms that a task counts before it lists the most frequent of them; of these, so many times the terms wanted are listed.
PART_TERMS, LISTED = 1 << 19, 3


def frequent_terms(docs: DataFrame, terms: Column, n: int) -> DataFrame:
    """term, df, total of the n terms with the largest total, ties by term, of documents of which each is one row. Exact, and most terms are never shuffled.

    Tasks count their terms part by part and list the most frequent of each, with the largest total that they left out. What
    a term is listed with is at least its total; the left-out totals of the parts that do not list it bound what it may have
    besides. Terms that cannot reach the n-th place go, the others are counted. If a term listed nowhere could reach it, or
    too many are left, all terms are counted.
    """
    most = LISTED * n

    def listed(part: pa.Table) -> Iterator[pa.RecordBatch]:
        totals, left = part.column("total").to_numpy(), 0
        if len(totals) > most:
            left = int(np.partition(totals, len(totals) - most - 1)[len(totals) - most - 1])
            part = part.filter(pa.array(totals > left))
        part = part.append_column("left", pa.array(np.full(len(part), left)))
        yield from part.combine_chunks().to_batches(max_chunksize=10_000)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), *(pa.array([x], pa.int64()) for x in (0, 0, left))], ["term", "df", "total", "left"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, rows = None, [], 0
        for batch in _slices(batches, 2048):
            waiting.append(_slice_counts(batch.column("__t")))
            rows += len(waiting[-1])
            if rows >= PART_TERMS:
                part, waiting, rows = _added(part, waiting), [], 0
                if len(part) >= PART_TERMS:
                    yield from listed(part)
                    part = None
        if part is not None or waiting:
            yield from listed(_added(part, waiting))

    sums = docs.select(terms.alias("__t")).mapInArrow(run, f"{_COUNTS}, left long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("df", "total", "left")))
    sums = cut(sums, "listed")
    left = sums.filter("term IS NULL").agg(F.coalesce(F.sum("left"), F.lit(0))).first()[0]
    places = sums.filter("term IS NOT NULL")
    least = places.orderBy(F.desc("total"), "term").limit(n).agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("least")).first()
    if not left:
        return places.orderBy(F.desc("total"), "term").limit(n).select("term", "df", "total")  # every part listed all its terms
    among = None
    if least["n"] == n and left < least["least"]:
        near = places.filter(F.col("total") + F.lit(left) - F.col("left") >= least["least"]).select("term").limit(8 * n + 1).collect()
        among = [r["term"] for r in near] if len(near) <= 8 * n else None
    return term_counts(docs, terms, among).orderBy(F.desc("total"), "term").limit(n)


def _added(part: pa.Table | None, found: list[pa.RecordBatch]) -> pa.Table:
    rows = pa.concat_tables([*([] if part is None else [part]), pa.Table.from_batches(found, pa.schema([("term", pa.string()), ("df", pa.int64()), ("total", pa.int64())]))])
    sums = rows.group_by("term", use_threads=False).aggregate([("df", "sum"), ("total", "sum")])
    return pa.table({"term": sums.column("term"), "df": sums.column("df_sum"), "total": sums.column("total_sum")})


def fitted(docs: DataFrame, terms: Column, how: Vectorizer, n_docs: int, repeat: bool) -> DataFrame:
    """What how.fit finds on the postings of docs; `repeat`: several rows may have one doc_id."""
    if repeat:
        return how.fit(postings(docs, terms), n_docs)
    idf = idf_smooth if how.smooth else idf_plain
    return frequent_terms(docs, terms, how.max_features).select("term", idf(F.col("df"), n_docs).alias("idf"))


def weighted(docs: DataFrame, terms: Column, how: Vectorizer, idf: DataFrame, repeat: bool, *keep: str) -> DataFrame:
    """What how.transform makes of the postings of docs: doc_id, kept columns, term, weight. Rows weigh their own terms with the
    broadcast idf, of which there are max_features."""
    if repeat:
        return how.transform(postings(docs, terms, *keep), idf)
    rows = idf.collect()  # max_features
    held = docs.sparkSession.sparkContext.broadcast((pa.array([r["term"] for r in rows], pa.string()), np.array([r["idf"] for r in rows], dtype=float)))
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, values = held.value
        for batch in _slices(batches):
            known, row, code, tf = _counted(batch.column("__t"))
            at = pc.fill_null(pc.index_in(known.cast(pa.string()), value_set=wanted), -1).to_numpy()[code]
            own = at >= 0
            row, at, tf = row[own], at[own], tf[own]
            weight = (1 + np.log(tf) if how.sublinear else tf) * values[at] if len(at) else np.zeros(0)
            if how.l2:
                weight = weight / np.sqrt(np.bincount(row, weights=weight * weight, minlength=batch.num_rows))[row]
            kept = batch.select(names).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, wanted.take(pa.array(at)), pa.array(weight, pa.float64())], [*names, "term", "weight"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, terms.alias("__t")).mapInArrow(run, f"{kinds}, term string, weight double")


def vector_rows(docs: DataFrame, terms: Column, how: Vectorizer, idf: DataFrame, known: list[str]) -> DataFrame:
    """doc_id, at, x of documents of which each is one row: the places in `known`, the sorted terms of idf, of its terms, ascending, and their weights before any norm."""
    rows = {r["term"]: r["idf"] for r in idf.collect()}  # max_features
    held = docs.sparkSession.sparkContext.broadcast((pa.array(known, pa.string()), np.array([rows[t] for t in known], dtype=float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, values = held.value
        for batch in _slices(batches):
            found, row, code, tf = _counted(batch.column("__t"))
            at = pc.fill_null(pc.index_in(found.cast(pa.string()), value_set=wanted), -1).to_numpy()[code]
            own = at >= 0
            row, at, tf = row[own], at[own], tf[own]
            order = np.lexsort((at, row))
            row, at, tf = row[order], at[order], tf[order]
            x = (1 + np.log(tf) if how.sublinear else tf.astype(float)) * (values[at] if len(at) else 1.0)
            begins = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(begins, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(begins, pa.array(x.astype(float)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "at", "x"])

    return docs.select("doc_id", terms.alias("__t")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, at array<int>, x array<double>")


def sparse_rows(weights: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, ...) with `at` and `x`, the numbers of their terms, ascending, and their weights; both empty for a document without known terms."""
    found = weights.select("doc_id", "term", "weight").join(F.broadcast(ids), "term").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term_id", "weight"))).alias("__m"))
    joined = docs.join(found, "doc_id", "left")
    return joined.withColumns({"at": F.coalesce("__m.term_id", F.array().cast("array<int>")), "x": F.coalesce("__m.weight", F.array().cast("array<double>"))}).drop("__m")


def class_term_means(weights: DataFrame, class_sizes: DataFrame, value: str = "tfidf") -> DataFrame:
    """class, term, score: mean over all documents of the class, those without the term counting as zero."""
    sums = weights.groupBy("class", "term").agg(F.sum(value).alias("total"))
    return null_safe_join(sums, F.broadcast(class_sizes), "class").select("class", "term", (F.col("total") / F.col("n_docs")).alias("score"))


def top_terms(means: DataFrame, n: int = 10) -> DataFrame:
    """The n best terms a class by score rounded to 6 digits, then term; only scores above 0, filtered after ranking."""
    rounded = means.withColumn("score", F.round("score", 6))
    ranked = rounded.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "term")))
    return ranked.filter((F.col("rank") <= n) & (F.col("score") > 0))


def matrix_stats(post: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    cells = n_docs * n_terms
    sparsity = F.lit(0.0) if not cells else (1 - F.col("nnz") / F.lit(float(cells))) * 100
    return post.agg(F.count(F.lit(1)).alias("nnz")).select(F.lit(n_docs).cast("long").alias("n_docs"), F.lit(n_terms).cast("long").alias("n_terms"), "nnz", F.round(sparsity, 6).alias("sparsity"))
