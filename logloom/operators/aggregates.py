"""The aggregate catalogue: names, output columns, and grouping.

Output columns: `sum` keeps the column's name, the others add `_min`, `_max`, `_mean`, `_median`, `_p95`,
`_stddev`, `_percent`; `intervals_X_Y` adds one column per bucket.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.columns import col, quoted
from logloom.functions.times import floor_time, parse_bucket
from logloom.operators.histograms import bucket_counts, histograms
from logloom.operators.percentiles import percentiles_of, same_keys, select_by_digits, value_counts

# Aggregate name -> (suffix of the internal column, suffix of the report header).
CATALOGUE = {
    "sum": ("", " (sum)"),
    "min": ("_min", " (min)"),
    "max": ("_max", " (max)"),
    "mean": ("_mean", " (avg)"),
    "median": ("_median", " (mdn)"),
    "p95": ("_p95", " (P95)"),
    "stddev": ("_stddev", " (stddev)"),
    "percent": ("_percent", " (% влияния)"),
}

# The fractions behind the two percentile aggregates.
PERCENTILES = {"median": 0.5, "p95": 0.95}

# Most interval buckets that are counted by an expression each; more are counted by number.
NARROW = 24

# Fixed value: the largest N in roundtime_Nu.
MAX_ROUND = 9999


@dataclass(frozen=True)
class Measure:
    column: str
    aggregates: tuple[str, ...]


def intervals_of(name: str) -> tuple[int, int] | None:
    """(step, count) of `intervals_X_Y`, else None."""
    found = re.fullmatch(r"intervals_(\d+)_(\d+)", name, flags=re.ASCII)
    return (int(found[1]), int(found[2])) if found else None


def roundtime_of(name: str) -> str | None:
    """Bucket text of `roundtime_Nu`, else None."""
    found = re.fullmatch(r"roundtime_(\d+[smhd])", name, flags=re.ASCII)
    return found[1] if found else None


def check_aggregate(name: str) -> None:
    """Raise ValueError unless the name is in the catalogue."""
    steps, bucket = intervals_of(name), roundtime_of(name)
    if steps and min(steps) < 1:
        raise ValueError(f"{name}: step and count must be positive")
    if bucket:
        parse_bucket(bucket)
        if int(bucket[:-1]) > MAX_ROUND:
            raise ValueError(f"{name}: at most {MAX_ROUND} units")
    if not steps and not bucket and name not in CATALOGUE:
        raise ValueError(f"unknown aggregate {name!r}")


def interval_buckets(step: int, count: int) -> list[tuple[str, int, int | None]]:
    """(label, lower bound, upper bound) per bucket, ascending; the last is open."""
    buckets = [(f"{step * i}-{step * (i + 1)}" if i else f"<{step}", step * i, step * (i + 1)) for i in range(count)]
    return [*buckets, (f"{step * count}>", step * count, None)]


def output_columns(column: str, aggregate: str) -> dict[str, str]:
    """Internal column name -> header suffix, for one aggregate of one column."""
    steps = intervals_of(aggregate)
    if steps:
        return {f"{column}_{aggregate}_{label}": f" ({label})" for label, _, _ in interval_buckets(*steps)}
    bucket = roundtime_of(aggregate)
    if bucket:
        return {column: f" (round {bucket})"}
    suffix, header = CATALOGUE[aggregate]
    return {column + suffix: header}


def _total(c: Column) -> Column:
    """The sum, 0 of nothing; NULL if it is beyond the type's range."""
    return F.when(F.count(c) == 0, F.lit(0)).otherwise(F.try_sum(c))


def _interval_shares(column: str, aggregate: str) -> list[Column]:
    c, shares = col(column), []
    for label, low, high in interval_buckets(*intervals_of(aggregate)):
        inside = c >= low if high is None else (c >= low) & (c < high)
        share = F.count_if(inside) / F.count(F.lit(1)) * 100
        shares.append(F.round(share, 2).alias(f"{column}_{aggregate}_{label}"))
    return shares


def _plain(column: str, aggregate: str) -> list[Column]:
    """Aggregates that need one grouping pass and no more."""
    c = col(column)
    if intervals_of(aggregate):
        return _interval_shares(column, aggregate)
    made = {
        "sum": _total(c), "min": F.min(c), "max": F.max(c), "mean": F.avg(c), "stddev": F.stddev_pop(c),
    }
    return [made[aggregate].alias(column + CATALOGUE[aggregate][0])] if aggregate in made else []


@dataclass(frozen=True)
class Asked:
    """What is computed of each column: its aggregates in order, each once."""

    names: dict[str, tuple[str, ...]]

    @classmethod
    def of(cls, measures: list[Measure]) -> Asked:
        names: dict[str, tuple[str, ...]] = {}
        for m in measures:
            wanted = [*names.get(m.column, ()), *(a for a in m.aggregates if not roundtime_of(a))]
            names[m.column] = tuple(dict.fromkeys(wanted))
        return cls(names)

    @property
    def shares(self) -> dict[str, str]:
        """Columns with a share of the total, and the column that holds a group's sum."""
        return {c: c if "sum" in names else f"__sum_{c}" for c, names in self.names.items() if "percent" in names}

    @property
    def percentiles(self) -> dict[str, dict[str, float]]:
        """Columns with percentiles: output names and fractions."""
        chosen = {c: {c + CATALOGUE[n][0]: PERCENTILES[n] for n in names if n in PERCENTILES} for c, names in self.names.items()}
        return {c: wanted for c, wanted in chosen.items() if wanted}

    @property
    def intervals(self) -> list[tuple[str, str]]:
        """(column, aggregate) of the interval histograms."""
        return [(c, n) for c, names in self.names.items() for n in names if intervals_of(n)]


Keep = Callable[[DataFrame], DataFrame]


def aggregate(df: DataFrame, keys: list[str], measures: list[Measure], keep: Keep | None = None) -> DataFrame:
    """Group by `keys` (NULL is a group) and compute all measures.

    One partial/final aggregation serves all measures but percentiles, which are counted together on
    their own narrow projection and joined to the groups, as are histograms of many buckets. The result is lazy, unless `keep`
    is given, which writes a table and reads it back: percentiles are then selected with a bound on what one task orders.
    """
    asked = Asked.of(measures)
    wide = asked.intervals if sum(intervals_of(n)[1] for _, n in asked.intervals) > NARROW else []
    groups = [col(k) for k in keys]
    expressions = [e for c, names in asked.names.items() for n in names if (c, n) not in wide for e in _plain(c, n)]
    expressions += [_total(col(c)).alias(total) for c, total in asked.shares.items() if total != c]
    if wide:
        expressions.append(F.count(F.lit(1)).alias("__rows"))
    result = df.groupBy(*groups).agg(*expressions) if expressions else df.select(*groups).distinct()
    counted = value_counts(df, keys, list(asked.percentiles)) if asked.percentiles else None
    buckets = bucket_counts(df, keys, [(c, *intervals_of(n)) for c, n in wide]) if wide else None
    return completed(result, keys, asked, counted, buckets, wide, keep)


def completed(
    result: DataFrame, keys: list[str], asked: Asked, counted: DataFrame | None, buckets: DataFrame | None, wide: list[tuple[str, str]],
    keep: Keep | None = None,
) -> DataFrame:
    """Groups with their shares of the total, and the percentiles and histograms that `counted` and `buckets` give."""
    grouped = result
    for column, total in asked.shares.items():
        # one number from the groups, computed as a scalar subquery
        everything = grouped.agg(_total(col(total)).alias("__all")).scalar()
        share = F.round(F.try_divide(col(total), everything) * 100, 2)
        result = result.withColumn(column + CATALOGUE["percent"][0], share)
    if counted is not None:
        found = select_by_digits(counted, keys, asked.percentiles, keep) if keep else percentiles_of(counted, keys, asked.percentiles)
        names = [name for chosen in asked.percentiles.values() for name in chosen]
        result = (
            result.alias("l")
            .join(found.alias("r"), same_keys("l", "r", keys), "left")
            .select("l.*", *[F.col(f"r.`{name}`") for name in names])
        )
    if buckets is not None:
        found = histograms(buckets, keys, [(c, *intervals_of(n)) for c, n in wide])
        result = result.alias("l").join(found.alias("r"), same_keys("l", "r", keys), "left")
        arrays = [
            F.transform(F.coalesce(f"r.__h{i}", F.array_repeat(F.lit(0).cast("bigint"), intervals_of(n)[1] + 1)), lambda c: F.round(c / F.col("l.__rows") * 100, 2))
            for i, (_, n) in enumerate(wide)
        ]
        result = result.select("l.*", *[shares.alias(f"__h{i}") for i, shares in enumerate(arrays)])
        parts = [
            f"get(__h{i}, {b}) AS {quoted(f'{c}_{n}_{label}')}"
            for i, (c, n) in enumerate(wide) for b, (label, _, _) in enumerate(interval_buckets(*intervals_of(n)))
        ]
        result = result.selectExpr("*", *parts).drop(*[f"__h{i}" for i in range(len(wide))])
    return result.drop("__rows", *[total for c, total in asked.shares.items() if total != c])


def round_times(df: DataFrame, measures: list[Measure]) -> DataFrame:
    """Floor, in place, every column that asks for `roundtime_Nu`."""
    for m in measures:
        for bucket in filter(None, map(roundtime_of, m.aggregates)):
            df = df.withColumn(m.column, floor_time(col(m.column), bucket))
    return df
