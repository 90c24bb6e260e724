"""Values of mixed kind: a VARIANT holds a whole number, another number or text, whichever a property's text reads as.

Text keeps what it says, numbers compare, sort and calculate as numbers. `5`, `5.0` and `5e0` are the same whole number; numbers beyond
64 bits are doubles. VARIANT itself neither compares nor sorts in Spark, so conditions go through these functions;
comparisons stay bare `variant_get`s, which Spark reads from Parquet as columns of their own and pushes down.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import text

VARIANT = T.VariantType()


def from_text(c: Column) -> Column:
    """Property text as a value: a whole number, a number, else the text itself."""
    whole, number = text.to_integer(c), text.to_number(c)
    return F.when(whole.isNotNull(), whole.cast(VARIANT)).when(number.isNotNull(), number.cast(VARIANT)).otherwise(c.cast(VARIANT))


def is_text(c: Column) -> Column:
    """Whether a value is text; NULL for NULL."""
    return F.schema_of_variant(c) == "STRING"


def as_double(c: Column) -> Column:
    """A value as Spark casts it: text such as `NaN` or `1d` becomes a number too, so pair this with `is_text`."""
    return F.try_variant_get(c, "$", "double")


def number(c: Column) -> Column:
    """The value of a number as DOUBLE; NULL for text."""
    return F.when(~is_text(c), as_double(c))


def plain_text(c: Column) -> Column:
    """The value of a text; NULL for a number."""
    return F.when(is_text(c), F.try_variant_get(c, "$", "string"))


def shown(c: Column) -> Column:
    """Any value as text, the same for equal numbers: what groups are formed by and CSV shows."""
    return F.try_variant_get(c, "$", "string")
