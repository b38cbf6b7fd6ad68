"""Stemming (X2) and the whole normalisation of a text: tokens, then stems."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from doclens.functions.porter2 import stem
from doclens.functions.text import tokens


@lru_cache(maxsize=1 << 16)
def remembered(word: str) -> str:
    """The stem of a word; a worker keeps the latest ones, as most tokens of a corpus are few words."""
    return stem(word)


@F.pandas_udf(ArrayType(StringType()))
def stem_arrays(words: pd.Series) -> pd.Series:
    return words.map(lambda row: None if row is None else [remembered(w) for w in row])


def stemmed_words(text: Column) -> Column:
    """The stems of the text's tokens, in order; none for a null or blank text."""
    return stem_arrays(tokens(text))


def normalize_stemmed(text: Column) -> Column:
    """The text as every index and classifier takes it: stems between spaces, an empty string where there are no tokens."""
    return F.array_join(stemmed_words(text), " ")


def stemmed_tokens(rows: DataFrame, words: str = "w") -> DataFrame:
    """doc_id, text: the stems of each document's tokens, in order; every row stays, without tokens as an empty text."""
    return rows.select("doc_id", F.coalesce(F.array_join(stem_arrays(F.col(words)), " "), F.lit("")).alias("text"))
