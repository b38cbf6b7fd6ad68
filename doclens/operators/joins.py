"""Joins in which a null key equals a null key: null classes are classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """left joined with right on columns of the same name, nulls being equal; the columns of left, then what right has besides.

    For `how` of inner, left, left_anti and left_semi.
    """
    names = [on] if isinstance(on, str) else list(on)
    renamed = right.select(*(F.col(n).alias(f"__r_{n}") for n in names), *(c for c in right.columns if c not in names))
    same = reduce(lambda a, b: a & b, (left[n].eqNullSafe(renamed[f"__r_{n}"]) for n in names))
    return left.join(renamed, same, how).drop(*(f"__r_{n}" for n in names))
