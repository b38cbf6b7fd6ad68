"""Corpus guards, samples and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.operators import tfidf as tf


def require_documents(docs: DataFrame, least: int) -> DataFrame:
    """docs, or an error where there are fewer than `least`; at most that many rows are read for it."""
    if docs.limit(least).count() < least:
        raise ValueError(f"the corpus has fewer than {least} documents")
    return docs


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of md5(key-seed)."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), key).limit(n)


def corpus_summary(docs: DataFrame, terms: Column) -> DataFrame:
    """class, n_docs, n_tokens, n_terms and a TOTAL row."""
    post = tf.postings(docs, terms, "class")
    sizes = docs.rollup("class").agg(F.count(F.lit(1)).alias("n_docs"), F.grouping("class").alias("whole"))
    by_class = post.groupBy("class").agg(F.sum("tf").alias("n_tokens"), F.countDistinct("term").alias("n_terms")).withColumn("whole", F.lit(0).cast("byte"))
    total = post.agg(F.lit(None).cast("string").alias("class"), F.lit(1).cast("byte").alias("whole"), F.sum("tf").alias("n_tokens"), F.countDistinct("term").alias("n_terms"))
    both = sizes.alias("s").join(by_class.unionByName(total).alias("t"), F.col("s.class").eqNullSafe(F.col("t.class")) & (F.col("s.whole") == F.col("t.whole")), "left")
    return both.select(F.when(F.col("s.whole") == 1, "TOTAL").otherwise(F.col("s.class")).alias("class"), "n_docs", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


def text_distance(a: Column, b: Column) -> Column:
    """Edit distance, of recognised and true text."""
    return F.levenshtein(a, b).cast("long")


def throughput(n: int, seconds: float) -> float:
    return n / seconds if seconds > 0 else 0.0
