"""Events for several reports from one reading of the log.

Lines are framed once, for all wanted event types. An event that several reports want becomes a row for each of them, with that report's own
properties: which keys are asked for together decides what lies inside another key's quotes, so each report extracts with its own
pattern, over its own events only. The rows are kept as Parquet in a folder for each report.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import text
from logloom.functions.columns import col, with_computed
from logloom.functions.times import event_time, ntz
from logloom.operators.filters import all_of
from logloom.sources.events import (
    BUILT_IN, DERIVED, EventColumns, built_in_columns, has_properties, is_event_text, key_values, property_pattern, property_value, stored_votes, typed,
)
from logloom.sources.encodings import BY_FILE
from logloom.sources.framing import WHOLE, event_fragments, stitch, with_raw

# The folder of the fragments of events that cross a border between splits.
RIMS = -1


@dataclass(frozen=True)
class Wanted:
    """The events of one report."""

    columns: EventColumns
    event_name: str | None = None
    start: datetime | None = None
    end: datetime | None = None

    def condition(self, file_path: Column, raw: Column) -> Column:
        """Whether an event is one of the report's, as far as its type, its time and its properties tell."""
        keep = has_properties(raw, self.columns.required)
        at = event_time(F.substring_index(file_path, "/", -1), raw)
        if self.start is not None:
            keep &= at >= ntz(self.start)
        if self.end is not None:
            keep &= at <= ntz(self.end)
        if self.event_name is not None:
            keep = has_type(raw, self.event_name) & keep
        return keep


def has_type(raw: Column, event_name: str) -> Column:
    """Whether an event has this type."""
    return F.split_part(raw, F.lit(","), F.lit(2)) == event_name


def all_names(wants: list[Wanted]) -> tuple[str, ...] | None:
    """The event types that any report wants; None if one wants them all."""
    names = tuple(dict.fromkeys(w.event_name for w in wants))
    return None if None in names else names


def whole_period(wants: list[Wanted]) -> tuple[datetime | None, datetime | None]:
    """From the first start to the last end; open if one of them is."""
    starts, ends = [w.start for w in wants], [w.end for w in wants]
    return None if None in starts else min(starts), None if None in ends else max(ends)


def _parsed(framed: DataFrame, wants: list[Wanted], rim: str | None = None) -> DataFrame:
    """A row for each event and report: `__report`, the built-in columns, and `__e<i>`, which holds the columns of report i."""
    path, raw, beside = F.col("file_path"), F.col("raw"), [rim] if rim else []
    numbers = F.array(*[F.when(w.condition(path, raw), F.lit(i)) for i, w in enumerate(wants)])
    reports = F.when(is_event_text(raw), F.filter(numbers, lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))
    if rim:
        reports = F.when(F.col(rim).isNotNull(), F.array(F.lit(RIMS))).otherwise(reports)
    rows = framed.select("file_path", "raw", *beside, F.explode(reports).alias("__report"))
    mine = [F.col("__report") == i for i in range(len(wants))]
    for i, w in enumerate(wants):
        if w.columns.properties:
            found = F.regexp_extract_all(key_values(raw), F.lit(property_pattern(w.columns.properties)), F.lit(0))
            rows = with_computed(rows, f"__found{i}", F.when(mine[i], found))

    def own(i: int, columns: EventColumns) -> Column:
        values = {k: property_value(F.col(f"__found{i}"), k) for k in columns.properties}
        derived = {k: text.last_line(values[DERIVED[k]]) for k in columns.derived}
        fields = [*[v.alias(k) for k, v in derived.items()], *[text.restore_newlines(v).alias(k) for k, v in values.items()]]
        return F.when(mine[i], F.struct(*fields)).alias(f"__e{i}")

    filled = [i for i, w in enumerate(wants) if w.columns.properties]
    built_in = built_in_columns(path, raw)
    rows = rows.select("__report", *beside, *[c.alias(k) for k, c in built_in.items()], *[own(i, wants[i].columns) for i in filled])

    def chosen(i: int, columns: EventColumns) -> Column:
        names = [*columns.derived, *columns.properties]
        schema = T.StructType([*[f for f in rows.schema if f.name in BUILT_IN], *[T.StructField(n, T.StringType()) for n in names]])
        return all_of(columns.filters, schema, columns.properties, lambda key: F.col(f"__e{i}").getField(key) if key in names else col(key))

    passes = [mine[i] & chosen(i, w.columns) for i, w in enumerate(wants)]
    rows = rows.where(reduce(or_, passes, F.col(rim).isNotNull() if rim else F.lit(False)))

    def settled(i: int, columns: EventColumns) -> Column:
        names = [*columns.properties, *columns.derived]
        kinds = [typed(F.col(f"__e{i}").getField(n), columns.types.get(n, "string")).alias(n) for n in names]
        return F.when(mine[i], F.struct(*kinds)).alias(f"__e{i}")

    return rows.select("__report", *beside, *[col(k) for k in BUILT_IN], *[settled(i, wants[i].columns) for i in filled])


def events_of_all(
    lines: DataFrame, wants: list[Wanted], stage: str, in_file_order: bool = False, encoding: str | None = "auto",
) -> list[DataFrame]:
    """For each of `wants` the events that `log_events` gives, from one pass over the lines that keeps them in `stage`."""
    start, end = whole_period(wants)
    fragments = event_fragments(lines, all_names(wants), start, end, in_file_order)
    votes = stored_votes(lines, stage) if encoding == BY_FILE else None
    rim = F.when(F.col("role") != WHOLE, F.struct(*fragments.columns))
    once = with_raw(fragments.withColumn("__rim", rim), ["file_path", "__rim"], encoding, votes, only=F.col("role") == WHOLE)
    rows, spark = _parsed(once, wants, "__rim"), lines.sparkSession
    rows.hint("rebalance", "__report").write.partitionBy("__report").mode("overwrite").parquet(f"{stage}/events")
    saved = spark.read.schema(rows.schema).parquet(f"{stage}/events")
    rims = saved.where(F.col("__report") == RIMS).select("__rim.*")
    crossing = _parsed(with_raw(stitch(rims), ["file_path"], encoding, votes), wants)
    made = []
    for i, w in enumerate(wants):
        own = [F.col(f"__e{i}").getField(n).alias(n) for n in [*w.columns.properties, *w.columns.derived]]
        parts = [part.where(F.col("__report") == i).select(*[col(k) for k in BUILT_IN], *own) for part in (saved, crossing)]
        made.append(parts[0].unionByName(parts[1]))
    return made
