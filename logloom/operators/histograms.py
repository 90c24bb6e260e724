"""Histograms of groups with any number of buckets.

A row's bucket is one number, rows are counted by group and bucket, and a group's counts become one array. The plan
does not grow with the number of buckets, only the columns of the report do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.columns import col

#: What is counted: (column, step, number of closed buckets).
Histogram = tuple[str, int, int]


def bucket_of(c: Column, step: int, count: int) -> Column:
    """The number of the bucket `[i * step, (i + 1) * step)` that holds a number, `count` from `count * step` on; NULL below 0.

    The quotient may be rounded over a bucket's border, so the borders themselves decide.
    """
    guess = F.floor(c / step).cast("bigint")
    exact = F.when(c < guess * step, guess - 1).when(c >= (guess + 1) * step, guess + 1).otherwise(guess)
    return F.when(c >= step * count, F.lit(count).cast("bigint")).when(c >= 0, exact)


def bucket_counts(df: DataFrame, keys: list[str], wanted: list[Histogram]) -> DataFrame:
    """`keys`, `__i` (which of `wanted`), `__b` (bucket), `__n` (rows), combined before the shuffle; rows in no bucket are not there."""
    groups = [col(k) for k in keys]
    each = [F.struct(F.lit(i).alias("i"), bucket_of(col(c), step, count).alias("b")) for i, (c, step, count) in enumerate(wanted)]
    stacked = df.select(*groups, F.explode(F.array(*each)).alias("__s")).select(*groups, F.col("__s.i").alias("__i"), F.col("__s.b").alias("__b"))
    return stacked.where(F.col("__b").isNotNull()).groupBy(*groups, "__i", "__b").agg(F.count(F.lit(1)).alias("__n"))


def histograms(counts: DataFrame, keys: list[str], wanted: list[Histogram]) -> DataFrame:
    """`keys` and an array of counters `__h0`, `__h1`, ... for each of `wanted`; groups without any row in a bucket have no row."""
    groups = [col(k) for k in keys]
    maps = [F.map_from_entries(F.collect_list(F.when(F.col("__i") == i, F.struct("__b", "__n")))).alias(f"__m{i}") for i in range(len(wanted))]

    def counters(found: Column, count: int) -> Column:
        buckets = F.sequence(F.lit(0).cast("bigint"), F.lit(count).cast("bigint"))
        return F.transform(buckets, lambda b: F.coalesce(F.try_element_at(found, b), F.lit(0)))

    arrays = [counters(F.col(f"__m{i}"), count).alias(f"__h{i}") for i, (_, _, count) in enumerate(wanted)]
    return counts.groupBy(*groups).agg(*maps).select(*groups, *arrays)
