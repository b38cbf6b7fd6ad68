"""The most frequent terms without a shuffle of the rare ones, and what is written for an index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from doclens import catalog, catalog_files, session  # noqa: F401
from doclens.operators import search
from doclens.operators import tfidf as tf
from doclens.operators.search import SearchIndex
from doclens.sources import sparse


def corpus(n, apart):
    """Words of falling frequency and many that occur once; apart: every eighth of the documents has words of its own."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(n):
        words = [f"{k * 8 // n if apart else ''}w{min(int(r), 4000)}" for r in rng.zipf(1.3, 30)]
        rows.append((k, "a", f"a/a_{k:05d}.txt", " ".join([*words, f"once{k}"])))
    return rows


def frame(spark, n, apart=False):
    return spark.createDataFrame(corpus(n, apart), "doc_id long, class string, path string, text string").withColumn("w", F.split("text", " ")).repartitionByRange(6, "doc_id")


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("n", [1, 20, 5000])
def test_frequent_terms_are_those_of_a_whole_count(spark, monkeypatch, apart, n):
    monkeypatch.setattr(tf, "PART_TERMS", 400)
    docs = frame(spark, 3000, apart)
    whole = tf.term_counts(docs, F.col("w")).orderBy(F.desc("total"), "term").limit(n)
    assert tf.frequent_terms(docs, F.col("w"), n).orderBy(F.desc("total"), "term").collect() == whole.collect()
    assert tf.frequent_terms(docs.limit(0), F.col("w"), n).count() == 0


def test_rare_terms_are_not_shuffled_for_a_fit(spark, monkeypatch):
    counted = []
    original = tf.term_counts
    monkeypatch.setattr(tf, "term_counts", lambda docs, terms, among=None: counted.append(out := original(docs, terms, among)) or out)
    docs = frame(spark, 3000)
    found = tf.fitted(docs, F.col("w"), tf.Vectorizer(20), 3000, False)
    assert found.count() == 20
    assert len(counted) == 1 and counted[0].count() < 200 < docs.select(F.explode("w")).distinct().count()


def test_a_saved_index_holds_no_tokens(spark, tmp_path):
    docs = frame(spark, 60)
    SearchIndex.build(docs, F.col("w")).save(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/docs").columns == ["doc_id", "class", "path", "text"]
    index = SearchIndex.load(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, "w1 w2 once7")], "query_id int, query string").withColumn("w", F.split("query", " "))
    assert index.search(asked, F.col("w"), 3).collect()[0]["query_id"] == 1


def searched(docs, asked, k, vectorizer=None):
    index = SearchIndex.build(docs, F.col("w"), vectorizer)
    return {(r["query_id"], r["rank"]): (r["doc_id"], r["similarity"]) for r in index.search(asked, F.col("w"), k).collect()}


def test_many_queries_find_what_few_find(spark, monkeypatch):
    docs = frame(spark, 700)
    docs = docs.unionByName(docs.filter("doc_id < 40").crossJoin(spark.range(1, 9)).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("id")).drop("id"))  # nine copies of some
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(99999).cast("long")).withColumn("w", F.array().cast("array<string>")))
    asked = docs.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "w")
    monkeypatch.setattr(search, "DOCS_GROUP", 50)
    monkeypatch.setattr(search, "QUERIES_GROUP", 16)
    monkeypatch.setattr(search, "QUERIES_SIDE", 40)
    held = []
    monkeypatch.setattr(search, "hold", lambda df: held.append(df) or df)
    found = searched(docs, asked, 5)
    assert not any({"query_id", "doc_id"} <= set(df.columns) for df in held)  # no table of all pairs
    monkeypatch.setattr(search, "MANY", 10**9)
    assert found == searched(docs, asked, 5) and len(found) == 5 * asked.count()


def test_many_queries_of_an_index_without_rows_of_its_own(spark, monkeypatch):
    docs = frame(spark, 200)
    twice = docs.unionByName(docs.filter("doc_id < 5"))  # an id twice: its texts count as one
    asked = docs.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("query_id"), "w")
    few = tf.Vectorizer(30, sublinear=False)
    found = searched(twice, asked, 3, few)
    monkeypatch.setattr(search, "MANY", 10**9)
    assert found == searched(twice, asked, 3, few) and found


def test_rows_give_their_postings_and_the_matrix_holds_none(spark):
    docs = frame(spark, 300)
    assert sorted(tf.row_postings(docs, F.col("w")).collect()) == sorted(tf.postings(docs, F.col("w")).select("doc_id", "term", "tf").collect())
    session.release()
    assert catalog.QUERIES["k6_sparse_matrix"](spark, SF).count() > 0
    assert not any("term" in df.columns for df in session._held)


def test_distinct_cells_make_the_same_tiles(spark):
    cells = spark.createDataFrame([(r, c, float(r - c)) for r in range(0, 40, 3) for c in range(0, 50, 7)], "row long, column long, value double")
    how = sparse.Tiling(8, 16)
    rows = lambda distinct: sorted(map(str, sparse.tiles(cells, how, distinct=distinct).collect()))
    assert rows(True) == rows(False)


def test_columns_of_the_matrix_are_written_without_held_or_joined_weights(spark, monkeypatch):
    """Tiles of s15_sparse_columns come from rows that count their own terms, each cell going to its tile in one shuffle."""
    given, original = [], sparse.tiles
    monkeypatch.setattr(sparse, "tiles", lambda cells, how, row, column, value, distinct: given.append(distinct) or original(cells, how, row, column, value, distinct))
    monkeypatch.setattr(tf, "postings", lambda *a: pytest.fail("postings of the whole corpus"))
    assert catalog.QUERIES["s15_sparse_columns"](spark, SF).count() > 0
    assert given == [True]
