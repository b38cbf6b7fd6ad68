"""Registered queries that write files or tables, or run streams, over the driver's tables and read the outcome back.

What is written lies in the folder that driver and executors share. Each query has SQL for what must come back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.catalog import BAND, COURSE, FULL, HIST, ORACLE, PIX, POST, SEARCH, STRIP, TOKENS, _course, corpus, grams, images, metrics, posted, predictions, query, words
from doclens.functions import text as tx
from doclens.functions.image_codecs import write_bmp, write_png
from doclens.operators import evaluate as ev
from doclens.operators import images as im
from doclens.operators import ingest as ig
from doclens.operators import tfidf as tf
from doclens.operators.search import SearchIndex
from doclens.plans import images as pi
from doclens.plans.models import model_table
from doclens.plans.ocr import examples, ocr_results
from doclens.session import cut, hold, shared_dir
from doclens.sources import sinks
from doclens.sources import sparse as sp
from doclens.sources.corpus import cached_metrics, image_files, manifest, table, text_path, write_manifest
from doclens.streaming.quota import accepted, write_quota


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- image files ------------------------------------------------------------------------------------------------


@query("s1_image_tree", f"WITH {PIX} SELECT label::VARCHAR AS class, 'img_' || img_id || '.png' AS name, 8 AS height, 8 AS width, sum(v)::BIGINT AS total, sum(v * (8 * y + x))::BIGINT AS moment FROM px GROUP BY label, img_id")
def _(spark, d):
    """Every image as a PNG file in a folder of its class, found and decoded again."""
    root = _folder(spark, "tree")
    named = images(spark, d).select(F.col("label").cast("string").alias("class"), F.format_string("img_%d.png", "img_id").alias("name"), "pixels", F.lit(8).alias("width"))
    pi.write_image_files(named, root).count()
    found = pi.decode_images(image_files(spark, root))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)
    return found.select("class", "name", "height", "width", total(F.col("pixels")).alias("total"), total(F.transform("pixels", lambda v, i: v * i)).alias("moment"))


def _coded(rows: DataFrame) -> DataFrame:
    """path, class, name, content: every third image as BMP, the others as PNG, every seventh cut short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("img_id").to_pylist(), batch.column("label").to_pylist()
            found = []
            for k, p in zip(ids, batch.column("pixels").to_pylist(), strict=True):
                data = (write_bmp if k % 3 == 0 else write_png)(np.array(p, dtype=np.uint8).reshape(8, 8))
                found.append(data[: len(data) // 2] if k % 7 == 0 else data)
            names = [f"img_{k}.{'bmp' if k % 3 == 0 else 'png'}" for k in ids]
            yield pa.RecordBatch.from_arrays([pa.array([f"{c}/{n}" for c, n in zip(labels, names, strict=True)], pa.string()), pa.array(list(map(str, labels)), pa.string()), pa.array(names, pa.string()), pa.array(found, pa.binary())], ["path", "class", "name", "content"])

    return rows.select("img_id", "label", "pixels").mapInArrow(run, "path string, class string, name string, content binary")


@query("s7_decoded_files", f"WITH {PIX} SELECT label || '/img_' || img_id || CASE WHEN img_id % 3 = 0 THEN '.bmp' ELSE '.png' END AS path, img_id % 7 <> 0 AS readable, CASE WHEN img_id % 7 <> 0 THEN sum(v) ELSE -1 END::BIGINT AS total FROM px GROUP BY label, img_id")
def _(spark, d):
    """PNG and BMP files, some damaged: those have no pixels."""
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda s, v: s + v)
    return pi.decode_images(_coded(images(spark, d))).select("path", F.col("pixels").isNotNull().alias("readable"), F.coalesce(total, F.lit(-1)).alias("total"))


@query("a18_processing_counts", "SELECT r AS resolution, count(*) FILTER (vec_id % 7 <> 0) AS successes, count(*) FILTER (vec_id % 7 = 0) AS errors FROM embeddings, (SELECT unnest([16, 32]) AS r) GROUP BY r")
def _(spark, d):
    """Counts that the write of both resolutions observed."""
    return pi.process_images(_coded(images(spark, d)), _folder(spark, "processed"), (16, 32))


# ---- tables and texts -------------------------------------------------------------------------------------------


@query("s14_manifest_file", "SELECT event_type || '/' || event_id || '.jpg' AS path, event_type AS class_name, (event_id % 16)::INTEGER AS label FROM events")
def _(spark, d):
    path = _folder(spark, "manifest")
    rows = table(spark, d, "events").select(F.concat("event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("path"), F.col("event_type").alias("class_name"), (F.col("event_id") % 16).cast("int").alias("label"))
    half = F.col("label") < 8
    write_manifest(rows.filter(half), path)
    write_manifest(rows.filter(~half), path, append=True)
    return manifest(spark, path)


@query("s16_cached_metrics", f"{FULL} SELECT model, kind, accuracy, precision, recall, f1 FROM mt")
def _(spark, d):
    path = _folder(spark, "metrics")
    sinks.write_metrics(metrics(spark, d), path)
    return cached_metrics(spark, path)


@query("k3_texts", f"SELECT lang AS class, lang || '/' || lang || '_' || lpad(doc_id::VARCHAR, greatest(5, len(doc_id::VARCHAR))::INT, '0') || '.txt' AS path, len({STRIP('text')})::BIGINT AS raw_chars, md5(coalesce(array_to_string({TOKENS('text')}, ' '), '')) AS processed FROM documents")
def _(spark, d):
    """Raw and normalised texts, written by class and read again."""
    path = _folder(spark, "texts")
    docs = table(spark, d, "documents").select(F.col("lang").alias("class"), text_path(F.col("lang"), F.col("doc_id")).alias("path"), tx.strip(F.coalesce("text", F.lit(""))).alias("raw"), tx.normalize(F.coalesce("text", F.lit(""))).alias("processed"))
    sinks.write_texts(docs, path)
    return spark.read.parquet(path).select(F.col("class").cast("string").alias("class"), "path", F.length("raw").cast("long").alias("raw_chars"), F.md5("processed").alias("processed"))


@query("k5_vocabulary_file", f"WITH {POST}, {BAND} SELECT term FROM band")
def _(spark, d):
    post, path = posted(spark, d), _folder(spark, "vocabulary")
    sinks.write_vocabulary(tf.vocabulary(tf.document_frequency(post), tf.document_count(post)), path)
    return spark.read.text(path).select(F.col("value").alias("term"))


def _course_cells(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, term_id, tfidf, each place once. Where no id repeats, rows count their own terms and only the cells of the vocabulary are shuffled."""
    docs = corpus(spark, d)
    if tf.counted_ids(docs.select("doc_id"))[1]:
        weights = hold(_course(spark, d))
        return weights.join(tf.with_term_ids(weights.select("term").distinct()), "term")
    n = docs.filter(F.size(words()) > 0).count()
    vocab = cut(tf.with_term_ids(tf.vocabulary(tf.term_counts(docs, words()), n)), "vocabulary")
    places = vocab.select("term", F.col("term_id").cast("int").alias("term_id"), "df")
    found = tf.row_postings(docs, words()).withColumn("tf", F.col("tf").cast("int")).join(places, "term")
    return found.select("doc_id", "term_id", (F.col("tf") * tf.idf_log10(F.col("df"), n)).alias("tfidf"))


@query("k6_sparse_matrix", f"WITH {COURSE}, ids AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM band) SELECT doc_id, term_id::BIGINT AS term_id, round(tfidf, 6) AS tfidf FROM course JOIN ids USING (term)")
def _(spark, d):
    """The course's TF-IDF matrix in tiles, and all its cells read back."""
    path = _folder(spark, "matrix")
    sp.write_sparse(_course_cells(spark, d), path, row="doc_id", column="term_id", value="tfidf", distinct=True)
    return sp.read_sparse(spark, path).select(F.col("row").alias("doc_id"), F.col("column").alias("term_id"), F.round("value", 6).alias("tfidf"))


@query("s15_sparse_columns", f"WITH {COURSE}, ids AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM band) SELECT term_id::BIGINT AS term_id, count(*)::BIGINT AS n, round(sum(tfidf), 4) AS total FROM course JOIN ids USING (term) WHERE term_id BETWEEN 100 AND 299 GROUP BY term_id")
def _(spark, d):
    """What two hundred terms weigh, read from the tiles that hold their columns."""
    path, how = _folder(spark, "matrix"), sp.Tiling(tile_columns=256)
    sp.write_sparse(_course_cells(spark, d), path, how, row="doc_id", column="term_id", value="tfidf", distinct=True)
    return sp.read_sparse(spark, path, how, columns=(100, 300)).groupBy(F.col("column").alias("term_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s15_feature_files", f"WITH {HIST} SELECT img_id, label, v::INTEGER AS v, round(freq, 5) AS freq FROM hs JOIN embeddings ON vec_id = img_id")
def _(spark, d):
    path = _folder(spark, "features")
    histogram = im.histogram_column(F.col("pixels"))
    sinks.write_features(images(spark, d).select("img_id", "label", F.explode(F.array(F.struct(F.lit("hist").alias("kind"), histogram.alias("vector")), F.struct(F.lit("pixels").alias("kind"), F.col("pixels").cast("array<double>").alias("vector")))).alias("f")).select("img_id", "label", "f.*"), path)
    found = sinks.read_features(spark, path, "hist")
    return found.select("img_id", "label", F.posexplode("vector").alias("v", "f")).select("img_id", "label", "v", F.round(F.col("f").cast("double"), 5).alias("freq"))


@query("k7_report_file", f"{FULL}, rep AS (SELECT model, 0 AS place, class::VARCHAR AS class, precision, recall, f1, support FROM rp UNION ALL SELECT model, 1, 'accuracy', NULL, NULL, avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0 END), count(*) FROM p GROUP BY model UNION ALL SELECT model, 2, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rp GROUP BY model UNION ALL SELECT model, 3, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM rp GROUP BY model) SELECT model || '  ' || rpad(class, 26, ' ') || coalesce(printf('%10.4f', round(precision, 6)), repeat(' ', 10)) || coalesce(printf('%10.4f', round(recall, 6)), repeat(' ', 10)) || coalesce(printf('%10.4f', round(f1, 6)), repeat(' ', 10)) || printf('%9d', support::BIGINT) AS line FROM rep")
def _(spark, d):
    """The printed report, from the text file that it was written to."""
    path = _folder(spark, "report")
    sinks.write_report(ev.full_report(predictions(spark, d)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("j5_without_output", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    """Documents for which there is no label of any kind yet."""
    return ig.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", None)


@query("w7_examples", f"WITH r AS (SELECT lang AS class, lang || '/' || lang || '_' || lpad(doc_id::VARCHAR, greatest(5, len(doc_id::VARCHAR))::INT, '0') || '.txt' AS path, {STRIP('text')} AS raw FROM documents) SELECT class, path, left(raw, 500) AS sample_raw FROM r WHERE len(raw) > 50 AND class IN (SELECT DISTINCT class FROM r WHERE len(raw) > 50 ORDER BY class LIMIT 4) QUALIFY row_number() OVER (PARTITION BY class ORDER BY path) = 1")
def _(spark, d):
    """The first success of some length of each of the first classes."""
    rows = table(spark, d, "documents").select(text_path(F.col("lang"), F.col("doc_id")).alias("path"), F.col("lang").alias("class"), tx.strip(F.coalesce("text", F.lit(""))).alias("raw"))
    return examples(ocr_results(rows, tx.normalize)).select("class", "path", "sample_raw")


@query("x18_saved_index", ORACLE["x18_batch_search"])
def _(spark, d):
    """The eight queries on an index that was built, saved and loaded."""
    path = _folder(spark, "index")
    SearchIndex.build(corpus(spark, d).withColumn("w", words()), grams()).save(path)
    asked = spark.createDataFrame(list(SEARCH.items()), "query_id int, query string").withColumn("w", tx.tokens(F.col("query")))
    return SearchIndex.load(spark, path).search(asked, grams())


# ---- streams ----------------------------------------------------------------------------------------------------


@query("r3_stream_quota", "SELECT event_type AS class, event_id, n, event_type || '_' || lpad(n::VARCHAR, 5, '0') || '.jpg' AS file_name FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 150")
def _(spark, d):
    """Events streamed to a quota of 150 a class with keyed state, numbered and named."""
    rows, path = table(spark, d, "events").select("event_id", F.col("event_type").alias("class")), _folder(spark, "events")
    rows.write.parquet(path)
    classes = [r["class"] for r in rows.select("class").distinct().collect()]  # few
    out = _folder(spark, "quota")
    stream = spark.readStream.schema(rows.schema).parquet(path)
    write_quota(accepted(stream, dict.fromkeys(classes, 150), "event_id", "event_id"), out, _folder(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).select("class", "event_id", "n", "file_name")


# ---- all models -------------------------------------------------------------------------------------------------


@query("m13_model_table")
def _(spark, d):
    """All models of both kinds and their fusion, each a stage of a graph, compared in one table."""
    return model_table(spark, d, _folder(spark, "models")).drop("ord")
