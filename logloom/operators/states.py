"""Partial states of groups, which can be stored, put together later and finished to what `aggregate` gives for all rows at once.

A group's state is a row with, for each measured column, count, sum, least, greatest, mean and second moment; value counts carry what exact
percentiles need, bucket counts the histograms. All of these add up, moments by the pairwise rule that does not cancel.
States may have further keys (an hour, say) that are left out when they are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.columns import col
from logloom.operators.aggregates import CATALOGUE, Asked, Measure, completed, intervals_of
from logloom.operators.histograms import bucket_counts
from logloom.operators.percentiles import value_counts


@dataclass(frozen=True)
class States:
    """`groups`: a row for each group; `values` and `buckets`: what its percentiles and histograms need, NULL where there are none."""

    groups: DataFrame
    values: DataFrame | None
    buckets: DataFrame | None

    @property
    def tables(self) -> dict[str, DataFrame]:
        made = {"groups": self.groups, "values": self.values, "buckets": self.buckets}
        return {name: table for name, table in made.items() if table is not None}

    def and_those(self, other: States) -> States:
        """Both, not yet merged."""
        return States(**{n: None if t is None else t.unionByName(getattr(other, n)) for n, t in (("groups", self.groups), ("values", self.values), ("buckets", self.buckets))})


def _state(column: str, kind: T.DataType) -> Column:
    c = col(column)
    parts = [F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")]
    if isinstance(kind, T.NumericType):
        parts += [F.try_sum(c).alias("total"), F.avg(c).cast("double").alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2")]
    return F.struct(*parts)


def states_of(df: DataFrame, keys: list[str], measures: list[Measure]) -> States:
    """The states of the groups of `df`; one pass, combined before the shuffle."""
    asked = Asked.of(measures)
    groups = [col(k) for k in keys]
    states = [_state(c, df.schema[c].dataType).alias(f"__s{i}") for i, c in enumerate(asked.names)]
    intervals = [(c, *intervals_of(n)) for c, n in asked.intervals]
    return States(
        df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__rows"), *states),
        value_counts(df, keys, list(asked.percentiles)) if asked.percentiles else None,
        bucket_counts(df, keys, intervals) if intervals else None,
    )


def merged(states: States, keys: list[str]) -> States:
    """States that differ in nothing but keys left out become one."""
    groups, made = [col(k) for k in keys], {}
    parts = [F.sum("__rows").alias("__rows")]
    for field in states.groups.schema:
        if field.name.startswith("__s"):
            parts.append(_merged_state(field.name, field.dataType).alias(field.name))
    made["groups"] = states.groups.groupBy(*groups).agg(*parts)
    for name, table, cell, n in (("values", states.values, "__v", "__c"), ("buckets", states.buckets, "__b", "__n")):
        made[name] = None if table is None else table.groupBy(*groups, "__i", cell).agg(F.sum(n).alias(n))
    return States(**made)


def _merged_state(name: str, kind: T.StructType) -> Column:
    n = F.col(f"{name}.n")
    parts = [F.sum(n).alias("n"), F.min(f"{name}.low").alias("low"), F.max(f"{name}.high").alias("high")]
    if "total" in kind.names:
        total = F.col(f"{name}.total")
        beyond = F.max((n > 0) & total.isNull())  # a part's sum was too large for its type
        parts.append(F.when(~beyond, F.try_sum(total)).alias("total"))
        moments = F.aggregate(
            F.collect_list(F.when(n > 0, F.struct(n.cast("double").alias("n"), F.col(f"{name}.mean").alias("mean"), F.col(f"{name}.m2").alias("m2")))),
            F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")), _both,
        )
        parts += [F.when(F.sum(n) > 0, moments["mean"]).alias("mean"), F.when(F.sum(n) > 0, moments["m2"]).alias("m2")]
    return F.struct(*parts)


def _both(a: Column, b: Column) -> Column:
    """Count, mean and second moment of two parts together."""
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    mean = F.when(a["n"] == 0, b["mean"]).otherwise(a["mean"] + apart * b["n"] / n)
    return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"))


def finished(states: States, keys: list[str], measures: list[Measure]) -> DataFrame:
    """What `aggregate` gives for all rows behind the states; each group must have one state."""
    asked, made = Asked.of(measures), []
    for i, (column, names) in enumerate(asked.names.items()):
        state = F.col(f"__s{i}")
        numeric = "total" in states.groups.schema[f"__s{i}"].dataType.names
        total = F.when(state["n"] == 0, F.lit(0)).otherwise(state["total"]) if numeric else None
        # a mean is the sum by the count, as for all rows at once
        mean = F.coalesce(state["total"].cast("double") / state["n"], state["mean"]) if numeric else None
        given = {"min": state["low"], "max": state["high"]}
        if numeric:
            given |= {"sum": total, "mean": F.when(state["n"] > 0, mean), "stddev": F.sqrt(F.when(state["n"] > 0, state["m2"] / state["n"]))}
        wrong = [n for n in names if n in ("sum", "mean", "stddev", "percent") and not numeric]
        if wrong:
            raise ValueError(f"{column!r} is no number: {wrong}")
        made += [given[n].alias(column + CATALOGUE[n][0]) for n in names if n in given]
        if asked.shares.get(column, column) != column:
            made.append(total.alias(asked.shares[column]))
    result = states.groups.select(*[col(k) for k in keys], "__rows", *made)
    return completed(result, keys, asked, states.values, states.buckets, asked.intervals)
