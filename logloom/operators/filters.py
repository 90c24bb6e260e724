"""Row filters `{key, operation, value}`, AND-combined, as plain Column predicates."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, ge, gt, le, lt
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import mixed, regex, text
from logloom.functions.columns import col

_ORDERINGS = {"gt": gt, "ge": ge, "lt": lt, "le": le}
OPERATIONS = ("eq", "ne", *_ORDERINGS, "contains", "regex", "filled", "empty")


@dataclass(frozen=True)
class Filter:
    key: str
    operation: str
    value: Any = None

    def __post_init__(self) -> None:
        if not self.key or not self.operation:
            raise ValueError(f"a filter needs a key and an operation: {self}")
        if self.operation not in OPERATIONS:
            raise ValueError(f"unknown filter operation {self.operation!r}: use one of {OPERATIONS}")
        if self.operation == "regex":
            if not isinstance(self.value, str):
                raise ValueError(f"filter on {self.key!r}: a regular expression must be text")
            regex.to_java(self.value)


def load_filters(definitions: list[dict[str, Any]] | None) -> list[Filter]:
    """Checked filters from their JSON form; raises ValueError naming the first bad one."""
    filters = []
    for number, d in enumerate(definitions or [], start=1):
        try:
            filters.append(Filter(d.get("key"), d.get("operation"), d.get("value")))
        except ValueError as error:
            raise ValueError(f"filter {number}: {error}") from error
    return filters


def _as_float(value: Any) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float))


def _equals(c: Column, kind: T.DataType, value: Any) -> Column | None:
    """Typed equality; None where the types can never be equal, as for a number and a text."""
    if isinstance(kind, T.StringType) and isinstance(value, str):
        return c == F.lit(value)
    if isinstance(kind, T.NumericType) and _is_number(value):
        return c == F.lit(int(value) if isinstance(value, bool) else value)
    if isinstance(kind, T.BooleanType) and isinstance(value, bool):
        return c == F.lit(value)
    if isinstance(kind, T.VariantType) and isinstance(value, str):
        return F.coalesce(mixed.plain_text(c) == F.lit(value), F.lit(False))
    if isinstance(kind, T.VariantType) and _is_number(value):
        return F.coalesce(mixed.number(c) == F.lit(float(value)), F.lit(False))
    return None


def _equals_by_value(c: Column, value: Any) -> Column | None:
    """Equality for untyped property text: a number, if it reads as one."""
    if isinstance(value, str):
        return (c == F.lit(value)) & ~text.is_number(c)
    if _is_number(value):
        return F.coalesce(text.to_number(c) == F.lit(float(value)), F.lit(False))
    return None


def _compares(c: Column, kind: T.DataType, operation: str, value: Any) -> Column:
    bound = _as_float(value)
    if bound is None or bound != bound:
        return F.lit(False)
    compare = _ORDERINGS[operation]
    if isinstance(kind, T.StringType):
        return compare(text.to_number(c), F.lit(bound))
    if isinstance(kind, T.VariantType):
        value = mixed.as_double(c)
        return compare(value, F.lit(bound)) & ~mixed.is_text(c) & ~F.isnan(value)
    if isinstance(kind, T.IntegralType) and abs(bound) < 2**53:
        # a whole number on the same side of all whole numbers
        whole = {"gt": math.floor, "ge": math.ceil, "lt": math.ceil, "le": math.floor}[operation](bound)
        return compare(c, F.lit(whole).cast("bigint"))
    if isinstance(kind, T.NumericType):
        holds = compare(c.cast("double"), F.lit(bound))
        # NaN sorts above everything in Spark, but no comparison holds for it here
        return holds & ~F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else holds
    return F.lit(False)


def predicate(f: Filter, schema: T.StructType, loose: bool = False, at: Callable[[str], Column] = col) -> Column:
    """The filter as a condition; like false, NULL does not keep the row.

    Conditions on typed columns are bare comparisons, so that they reach the scan. `loose` is for
    property text without a declared type: values that read as numbers count as numbers, others as text. `at` says where
    a key's column is.
    """
    if f.key not in schema.names:
        return F.lit(f.operation == "empty")
    c, kind = at(f.key), schema[f.key].dataType
    if isinstance(kind, T.VariantType) and f.operation in ("contains", "regex"):
        c, kind = mixed.plain_text(c), T.StringType()
    elif isinstance(kind, T.VariantType) and f.operation in ("filled", "empty"):
        c, kind = mixed.shown(c), T.StringType()
    is_text = isinstance(kind, T.StringType)

    if f.operation == "filled":
        return c.isNotNull() & (text.strip(c) != "") if is_text else c.isNotNull()
    if f.operation == "empty":
        return c.isNull() | (text.strip(c) == "") if is_text else c.isNull()
    if f.operation in ("eq", "ne"):
        same = _equals_by_value(c, f.value) if loose and is_text else _equals(c, kind, f.value)
        if f.operation == "eq":
            return F.lit(False) if same is None else same
        return c.isNotNull() if same is None else c.isNotNull() & ~same
    if f.operation in _ORDERINGS:
        return _compares(c, kind, f.operation, f.value)
    if not is_text or not isinstance(f.value, str):
        return F.lit(False)
    found = F.contains(c, F.lit(f.value)) if f.operation == "contains" else c.rlike(regex.to_java(f.value))
    return found & ~text.is_number(c) if loose else found


def all_of(
    filters: list[Filter], schema: T.StructType, loose: list[str] | tuple[str, ...] = (), at: Callable[[str], Column] = col,
) -> Column:
    """All filters at once; no filters keep everything."""
    return reduce(and_, [predicate(f, schema, f.key in loose, at) for f in filters], F.lit(True))


def keep_rows(df: DataFrame, filters: list[Filter], loose: list[str] | tuple[str, ...] = ()) -> DataFrame:
    return df.where(all_of(filters, df.schema, loose)) if filters else df
