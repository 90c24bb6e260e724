"""Small helpers for addressing columns whose names hold `:` or other punctuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column called exactly `name`, e.g. `p:processName`."""
    return F.col(quoted(name))


def with_computed(df: DataFrame, name: str, value: Column, keep: list[str] | None = None) -> DataFrame:
    """Add a column that is costly to compute, so that it is computed once per row.

    Filters on a plain `withColumn` are pushed below it with the expression copied into each of them;
    nothing is copied through the explode of a one-element array.
    """
    return df.select(*[col(c) for c in (df.columns if keep is None else keep)], F.explode(F.array(value)).alias(name))
