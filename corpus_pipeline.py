"""From raw documents to packed training windows: five stages, each an operator of doclens.llm, each written and read again.

A stage takes (spark, docs, sf_dir) and returns the documents that stay, with all their columns; the last one returns
windows.

Defined cases. Null or empty texts go with the first stage (they have fewer than 50 words); a document without a language
goes with the second. A null doc_id is kept like any other, but in a group of near copies it counts after all others.
Repeated rows are copies: one of them stays; of a group's documents the one of the smallest doc_id does, so ties do not
arise. Very long texts are read in parts by every stage and stay whole. An empty table gives an empty result. Further
columns, of whatever name, pass through all stages but the last, which returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import cut, table
from doclens.llm.decontaminate import drop_contaminated
from doclens.llm.langid import keep_identified, learn_languages
from doclens.llm.near_dup import Join, keep_one
from doclens.llm.packing import pack
from doclens.llm.quality_rules import keep_good

#: Unless a contract says otherwise, near copies are sought on five-word shingles at a similarity of 0.8.
NEAR = Join(n=5, percent=80)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition limits."""
    return keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's own languages. The model is learned from the labelled documents of this stage's input."""
    return keep_identified(docs, learn_languages(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more), the document of the smallest id."""
    return keep_one(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens: one row a piece, with its token ids."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Learned models and token vocabularies are beyond SQL; tests/llm/test_corpus_operators.py holds every stage against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
