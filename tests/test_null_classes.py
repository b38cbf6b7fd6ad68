"""Null classes are classes, in every operator that joins on them; numbers run through ranges of any key."""

import datetime

import pytest
from pyspark.sql import functions as F

from doclens.operators import ingest as ig
from doclens.operators import learning as ml
from doclens.operators import numbering as nu
from doclens.operators import tfidf as tf
from doclens.operators.joins import null_safe_join


def test_join(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([(None, 7, 0), ("a", 8, 0)], "k string, y int, z int")
    assert {tuple(r) for r in null_safe_join(left, right, "k").collect()} == {(None, 1, 7, 0), ("a", 2, 8, 0)}
    assert null_safe_join(left, right, ["k"], "left").filter("y IS NULL").count() == 1
    assert [r["k"] for r in null_safe_join(left, right, "k", "left_anti").collect()] == ["b"]


def test_ingestion(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3)], "class string, id long")
    assert {(r["id"], r["class_id"]) for r in ig.class_index(rows, "class").collect()} == {(1, 0), (2, 1), (3, 1)}
    classes = spark.createDataFrame([(None,), ("a",), ("b",)], "class string")
    assert {(r["class"], r["missing"]) for r in ig.deficits(rows, classes, 2).collect()} == {(None, 1), ("a", 0), ("b", 2)}
    assert [r["class"] for r in ig.missing_classes(rows, classes, "class").collect()] == ["b"]
    have = spark.createDataFrame([(None, 5)], "class string, n long")
    assert {(r["id"], r["n"]) for r in ig.running_number(rows, "class", ["id"], have).collect()} == {(1, 6), (2, 1), (3, 2)}


def test_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "doc_id long, class string")
    post = spark.createDataFrame([(1, None, "x", 3.0), (2, None, "x", 2.0), (3, "a", "y", 4.0), (4, "a", "y", 1.0)], "doc_id long, class string, term string, weight double")
    means = tf.class_term_means(post.withColumnRenamed("weight", "tfidf"), docs.groupBy("class").agg(F.count("*").alias("n_docs")))
    assert {(r["class"], r["term"], r["score"]) for r in means.collect()} == {(None, "x", 2.5), ("a", "y", 2.5)}
    model = ml.multinomial_nb(post, docs, post.select("term").distinct())
    assert {(r["doc_id"], r["class"], r["predicted"]) for r in ml.nb_predictions(post, docs, model).collect()} == {(1, None, None), (2, None, None), (3, "a", "a"), (4, "a", "a")}


@pytest.mark.parametrize("kind", ["prefixed", "date", "timestamp", "decimal", "long"])
def test_numbers_of_any_key(spark, monkeypatch, kind):
    monkeypatch.setattr(nu, "RANGE_ROWS", 50)
    day = datetime.date(2024, 1, 1)
    make = {"prefixed": lambda k: f"http://host/path/{k:05d}", "date": lambda k: day + datetime.timedelta(k), "timestamp": lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=k), "decimal": lambda k: k, "long": lambda k: k}[kind]
    rows = spark.createDataFrame([(None if k % 101 == 0 else make(k * 7919 % 1000),) for k in range(1000)], {"prefixed": "k string", "date": "k date", "timestamp": "k timestamp", "decimal": "k int", "long": "k long"}[kind])
    rows = rows.withColumn("k", F.col("k").cast("decimal(20, 2)")) if kind == "decimal" else rows
    span = nu.range_of(rows, "k")
    sizes = [r["count"] for r in rows.groupBy(span.alias("s")).count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 200
    got = [r["k"] for r in nu.numbered(rows, ["k"], span).orderBy("n").collect()]
    assert got == sorted(got, key=lambda v: (v is not None, v if v is not None else 0)) and len(got) == 1000
    assert [r["n"] for r in nu.numbered(rows, ["k"], span).orderBy("n").collect()] == list(range(1, 1001))
