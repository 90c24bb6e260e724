"""Exact percentiles of groups of any size.

The built-in `percentile` keeps every distinct value of a group in one task's memory. Here a group is
spread over value ranges: values are counted, combined before the shuffle, so that a value is one row however
often it occurs; the counts give the few ranges that hold a wanted rank, and only values in those are put in
order. No task ever sees more of a group than its distinct values in one range. Where intermediate tables may be kept,
`select_by_digits` narrows crowded ranges down further, so that there is a bound for any distribution.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.columns import col

# Ranges are 1/64 apart in natural logarithm, i.e. about 1.6 % wide, on both sides of zero.
RANGES_PER_E = 64
_BEYOND = 50_000  # exceeds 64 * ln(largest double)


def value_range(v: Column) -> Column:
    """The number of the range that holds a DOUBLE; never decreases as the value grows."""
    magnitude = F.floor(F.ln(F.least(F.abs(v), F.lit(1.7976931348623157e308))) * RANGES_PER_E) + _BEYOND
    return (
        F.when(F.isnan(v), F.lit(3 * _BEYOND).cast("bigint"))
        .when(v > 0, magnitude)
        .when(v < 0, -magnitude)
        .otherwise(F.lit(0).cast("bigint"))
    )


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """Join condition on keys in which NULL equals NULL; `left` and `right` are DataFrame aliases."""
    pairs = [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys]
    return reduce(and_, pairs, F.lit(True))


def _between(low: Column, high: Column, share: Column) -> Column:
    """Linear interpolation; the middle of two values is their mean, so a median has no extra rounding error."""
    return (
        F.when(low == high, low)
        .when(share == 0.5, (low + high) / 2)
        .when(share < 0.5, low + (high - low) * share)
        .otherwise(high - (high - low) * (1 - share))
    )


def exact_percentiles(df: DataFrame, keys: list[str], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """Per group, exact percentiles with linear interpolation; NULL values do not count.

    `wanted` maps columns to output names and fractions; all columns are counted in one go. Groups without any
    value have no row, columns without any are NULL.
    """
    return percentiles_of(value_counts(df, keys, list(wanted)), keys, wanted)


def value_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """`keys`, `__i` (which of `columns`), `__v` (a value as DOUBLE), `__c` (how often the group has it)."""
    groups = [col(k) for k in keys]
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    rows = df.select(*groups, stacked.alias("__s")).select(*groups, F.col("__s.i").alias("__i"), F.col("__s.v").alias("__v"))
    return rows.where(F.col("__v").isNotNull()).groupBy(*groups, "__i", "__v").agg(F.count(F.lit(1)).alias("__c"))


def percentiles_of(counts: DataFrame, keys: list[str], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """Per group, exact percentiles from `value_counts` over the columns of `wanted`, as one lazy plan."""
    parts = [*keys, "__i"]
    counts = counts.withColumn("__r", value_range(F.col("__v")))
    picks = Picks.of(wanted)
    ranges = _placed(counts.groupBy(*map(col, parts), "__r").agg(F.sum("__c").alias("__n")), parts, "__r")
    chosen = ranges.where(picks.hit()).select(*map(col, parts), "__r", "__before", "__total")
    inside = _inside(counts, chosen, parts, "__r")
    return picks.taken(_in_order(inside, [*parts, "__r"]), keys)


@dataclass(frozen=True)
class Picks:
    """The ranks that are wanted: (number of the column, output name, fraction)."""

    picks: list[tuple[int, str, float]]
    columns: int

    @classmethod
    def of(cls, wanted: dict[str, dict[str, float]]) -> Picks:
        return cls([(i, name, p) for i, chosen in enumerate(wanted.values()) for name, p in chosen.items()], len(wanted))

    @staticmethod
    def _holds(rank: Column) -> Column:
        return (F.col("__before") <= rank) & (rank < F.col("__upto"))

    def hit(self) -> Column:
        """Whether a row, which covers the ranks from `__before` to `__upto` of `__total`, holds one that is wanted."""
        rank = lambda p: (F.col("__total") - 1) * F.lit(float(p))
        return reduce(or_, [(F.col("__i") == i) & self._holds(f(rank(p))) for i, _, p in self.picks for f in (F.floor, F.ceil)])

    def taken(self, placed: DataFrame, keys: list[str]) -> DataFrame:
        """The percentiles, from single values `__v` that cover ranks."""
        groups = [col(k) for k in keys]
        rank = lambda p: (F.col("__total") - 1) * F.lit(float(p))
        ends = [
            F.max(F.when((F.col("__i") == i) & self._holds(f(rank(p))), F.col("__v"))).alias(f"__{side}{n}")
            for n, (i, _, p) in enumerate(self.picks) for side, f in (("low", F.floor), ("high", F.ceil))
        ]
        totals = [F.max(F.when(F.col("__i") == i, F.col("__total"))).alias(f"__total{i}") for i in range(self.columns)]
        found = placed.groupBy(*groups).agg(*totals, *ends)

        def share(i: int, p: float) -> Column:
            r = (F.col(f"__total{i}") - 1) * F.lit(float(p))
            return r - F.floor(r)

        return found.select(
            *groups, *[_between(F.col(f"__low{n}"), F.col(f"__high{n}"), share(i, p)).alias(name) for n, (i, name, p) in enumerate(self.picks)],
        )


def _placed(ranges: DataFrame, parts: list[str], order: str) -> DataFrame:
    """Ranges of a group's values with the ranks they cover: `__before`, `__upto` and the group's `__total`."""
    by = [col(k) for k in parts]
    return (
        ranges.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*by).orderBy(order)))
        .withColumn("__total", F.sum("__n").over(Window.partitionBy(*by)))
        .withColumn("__before", F.col("__upto") - F.col("__n"))
    )


def _inside(counts: DataFrame, chosen: DataFrame, parts: list[str], at: str) -> DataFrame:
    """The values of the chosen ranges, with what stands before their range."""
    pairs = same_keys("a", "b", parts) & (F.col(f"a.{at}") == F.col(f"b.{at}"))
    return (
        counts.alias("a").join(chosen.alias("b"), pairs)
        .select(*[F.col(f"a.`{k}`") for k in parts], f"a.{at}", "a.__v", "a.__c", "b.__before", "b.__total")
    )


def _in_order(inside: DataFrame, by: list[str]) -> DataFrame:
    """Values with the ranks that each of them covers."""
    running = F.sum("__c").over(Window.partitionBy(*map(col, by)).orderBy("__v"))
    return inside.withColumn("__upto", F.col("__before") + running).withColumn("__before", F.col("__upto") - F.col("__c"))


# ---- selection digit by digit --------------------------------------------------------------------

# Digits of the order-keeping form of a value, most significant first: what is left of it below each.
SHIFTS = (48, 32, 16, 0)
#: Most different values of a group that one task puts in order; and into how many parts a group's values are dealt for a join.
MOST_ORDERED, DEALT = 1 << 16, 16


def order_key(v: Column) -> Column:
    """A DOUBLE as a whole number in the same order: exponent above mantissa; both zeros are 0, NaN comes last.

    All steps are exact: scaling by powers of two, and the difference of a number between 1 and 2 from 1.
    """
    size = F.abs(v)
    guess = F.floor(F.log2(size))
    exponent = F.when(size < F.pow(F.lit(2.0), guess), guess - 1).when(size >= F.pow(F.lit(2.0), guess + 1), guess + 1).otherwise(guess)
    mantissa = (size / F.pow(F.lit(2.0), exponent) - 1) * F.lit(2.0**52)
    normal = (exponent + 1023).cast("bigint") * F.lit(2**52) + mantissa.cast("bigint")
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    infinite = F.lit(2047 * 2**52)
    key = F.when(size == F.lit(float("inf")), infinite).when(size < F.lit(2.0**-1022), tiny).otherwise(normal)
    return F.when(F.isnan(v), infinite + 1).when(v < 0, -key).otherwise(key)


def select_by_digits(
    counts: DataFrame, keys: list[str], wanted: dict[str, dict[str, float]], keep: Callable[[DataFrame], DataFrame], most: int = MOST_ORDERED,
) -> DataFrame:
    """As `percentiles_of`, for groups with any number of different values: no task puts more than `most` of a group's values in order.

    The value counts, and after each round the open ranges, go through `keep`, which writes them and reads them back. A round looks at one digit
    of the values in those ranges that hold a wanted rank and more than `most` different values.
    """
    parts, picks = [*keys, "__i"], Picks.of(wanted)
    kept = keep(counts.withColumn("__k", order_key(F.col("__v"))))
    by = [col(k) for k in parts]
    tally = [F.sum("__c").alias("__n"), F.count("*").alias("__d")]
    digit = lambda shift: F.shiftright("__k", shift).alias("__p")
    ranges = _placed(kept.groupBy(*by, digit(SHIFTS[0])).agg(*tally), parts, "__p").where(picks.hit())
    opened, closed = keep(ranges.select(*by, "__p", "__before", "__total", "__d")), []
    for upper, lower in zip(SHIFTS, SHIFTS[1:]):
        closed.append((upper, opened.where(F.col("__d") <= most)))
        large = opened.where(F.col("__d") > most)
        if not large.take(1):
            break
        # values of the open ranges by their next digit, each range dealt to several tasks
        dealt = large.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
        rows = kept.withColumn("__p", F.shiftright("__k", upper)).withColumn("__deal", F.pmod(F.xxhash64("__v"), F.lit(DEALT)).cast("int"))
        both = same_keys("a", "b", [*parts, "__p", "__deal"])
        values = rows.alias("a").join(dealt.alias("b"), both).select("a.*", "b.__before", "b.__total")
        lists = values.groupBy(*by, F.col("__p").alias("__q"), digit(lower)).agg(*tally, F.first("__before").alias("__from"), F.first("__total").alias("__total"))
        running = F.sum("__n").over(Window.partitionBy(*by, "__q").orderBy("__p"))
        ranges = lists.withColumn("__upto", F.col("__from") + running).withColumn("__before", F.col("__upto") - F.col("__n")).where(picks.hit())
        opened = keep(ranges.select(*by, "__p", "__before", "__total", "__d"))
    else:
        closed.append((SHIFTS[-1], opened))  # single values
    found = None
    for shift, chosen in closed:
        rows = _inside(kept.withColumn("__p", F.shiftright("__k", shift)), chosen, parts, "__p")
        placed = _in_order(rows, [*parts, "__p"])
        found = placed if found is None else found.unionByName(placed)
    return picks.taken(found, keys)
