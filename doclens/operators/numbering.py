"""Gapless numbers and quotas in an order, without one task that sorts a whole class.

Rows are dealt into ranges of the order whose bounds are values (not where a partitioning happened to cut), so a task that
is run again numbers its rows alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.session import hold

#: Rows that a range should have, about; and the ranges that are used at most.
RANGE_ROWS, MOST_RANGES = 100_000, 4096
#: Values of a sample for each range.
SAMPLE = 20


def range_of(rows: DataFrame, key: str) -> Column:
    """A range of the key, ascending with it, null first: of a number between approximate quantiles, of any other type that has an order between those of a sample."""
    kind = dict(rows.dtypes)[key]
    total = rows.count()
    n = min(MOST_RANGES, total // RANGE_ROWS)
    if n <= 1:
        return F.lit(0)
    if kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        bounds = sorted(set(rows.approxQuantile(key, [k / n for k in range(1, n)], 0.2 / n)))
    else:
        bounds = _sampled_bounds(rows, key, n, total)
    out = F.lit(0)
    if bounds:
        held = F.array(*map(F.lit, bounds))
        out = F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(held, lambda b: b <= F.col(key))))
    return out


def _sampled_bounds(rows: DataFrame, key: str, n: int, total: int) -> list:
    """At most n values that split rows about evenly, from the values whose hash falls into a share that some SAMPLE n of them are expected in.

    Which values are taken depends on themselves alone, so the bounds are the same whenever they are sought. A value that many
    rows share weighs as much as they do.
    """
    share = min(1.0, SAMPLE * n / max(1, total))
    taken = rows.filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))))
    values = taken.groupBy(key).agg(F.count(F.lit(1)).alias("c")).orderBy(key).collect()  # distinct values of the sample
    whole, so_far, bounds = sum(r["c"] for r in values), 0, []
    for before, r in zip([None, *values], values, strict=False):
        if before is not None and so_far * n >= whole * (len(bounds) + 1):
            bounds.append(r[key])
        so_far += r["c"]
    return bounds[: n - 1]


def numbered(rows: DataFrame, order: list[str], span: Column, by: list[str] | None = None, name: str = "n") -> DataFrame:
    """rows with their number from 1 in `order`, within `by` where given. `span` ascends with the order and splits it into ranges."""
    by = by or []
    dealt = rows.withColumn("__span", span)
    counts = dealt.groupBy(*by, "__span").agg(F.count(F.lit(1)).alias("__c"))
    so_far = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__span").alias("__s"), F.coalesce(F.sum("__c").over(so_far), F.lit(0)).alias("__before"))
    here = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*by, "__span").orderBy(*order)).cast("long"))
    same = F.col("__span") == F.col("__s")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = here.join(F.broadcast(before), same)  # one row a class and range, of which there are MOST_RANGES
    return joined.withColumn(name, F.col(name) + F.col("__before")).drop("__span", "__s", "__before", *(f"__{c}" for c in by))


def first_by_hash(rows: DataFrame, quotas: DataFrame, by: str, order: Column, tie: str) -> Column:
    """A condition on rows: among the first `quota` (quotas: by, quota) of its class in the order of the hex digest `order`, then tie.

    Only the rows of one 4096th of a class, the one in which the quota ends, are sorted; the bounds found come back as one
    row a class. Rows that share digest and tie stand or fall together.
    """
    keyed = rows.select(by, order.alias("__h"), F.col(tie).alias("__t")).withColumn("__b", F.substring("__h", 1, 3))
    counts = keyed.groupBy(by, "__b").agg(F.count(F.lit(1)).alias("__c"))
    so_far = Window.partitionBy(by).orderBy("__b")
    sums = counts.withColumn("__sum", F.sum("__c").over(so_far)).withColumnRenamed(by, "__by")
    ends = sums.join(F.broadcast(quotas), F.col("__by").eqNullSafe(F.col(by))).filter((F.col("quota") > F.col("__sum") - F.col("__c")) & (F.col("quota") <= F.col("__sum")))
    ends = hold(ends.select("__by", F.col("__b").alias("__end"), (F.col("quota") - F.col("__sum") + F.col("__c")).alias("__left")))
    last = keyed.join(F.broadcast(ends), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__b") == F.col("__end")))
    ranked = last.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy("__h", "__t"))).filter("__r = __left")
    bounds = {r[by]: (r["__h"], r["__t"]) for r in ranked.select(by, "__h", "__t").collect()}  # one row a class
    out = F.lit(False)
    for name, (h, t) in bounds.items():
        out = out | (F.col(by).eqNullSafe(F.lit(name)) & ((order < h) | ((order == h) & (F.col(tie) <= F.lit(t)))))
    return out
