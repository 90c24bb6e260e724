"""Reports: filter, round time, group, compute, sort, limit, lay out."""

from __future__ import annotations

import logging
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import mixed, text
from logloom.functions.columns import col
from logloom.functions.times import nearest_time
from logloom.operators.aggregates import Keep, Measure, aggregate, round_times
from logloom.operators.filters import keep_rows
from logloom.operators.formulas import add_formulas
from logloom.plans.spec import ReportSpec, SpecError, headers, parse_spec
from logloom.sources.events import BUILT_IN, PLACE, EventColumns, log_events, scratch_folder
from logloom.sources.files import list_skipped_files
from logloom.sources.lines import read_lines
from logloom.sources.shared import Wanted, events_of_all, whole_period
from logloom.sources.watch import Watch

log = logging.getLogger(__name__)

# Fixed value: digits that fractional columns of a grouped report are rounded to.
GROUPED_DIGITS = 2

# Most names of skipped files that go into one warning.
NAMED_FILES = 20

# Most staged files that a listing names when it reads back the rows it shows; beyond that it looks into all.
NAMED_PATHS = 1000


def event_columns(spec: ReportSpec) -> EventColumns:
    """What the report needs from the log; keys used only to filter or group are not required."""
    keys = [k.name for k in spec.keys if not k.formula]
    extra = [f.key for f in spec.filters] + list(spec.group_by)
    return EventColumns(
        keys=list(dict.fromkeys(keys)),
        extra=[k for k in dict.fromkeys(extra) if k not in keys and k not in BUILT_IN and k not in spec.formulas],
        types=spec.property_types,
        filters=list(spec.filters),
    )


def apply_times(df: DataFrame, spec: ReportSpec) -> DataFrame:
    """Both kinds of time rounding: floor of a named column, and nearest of `timestamp`."""
    df = round_times(df, [Measure(k.name, k.aggregates) for k in spec.keys])
    for key in spec.keys:
        if key.roundtime:
            df = df.withColumn("timestamp", nearest_time(F.col("timestamp"), key.roundtime))
    return df


def settle_mixed(df: DataFrame, spec: ReportSpec) -> DataFrame:
    """Columns of mixed kind as a grouped report takes them: keys as text, so that equal numbers meet, all else as numbers."""
    variants = [f.name for f in df.schema if isinstance(f.dataType, T.VariantType)]
    return df.withColumns({n: mixed.shown(col(n)) if n in spec.group_by else mixed.number(col(n)) for n in variants})


def sort_rows(df: DataFrame, keys: tuple[tuple[str, bool], ...], by_number: tuple[str, ...] = ()) -> DataFrame:
    """Sort by (column, descending); NULL comes first either way.

    `by_number` names text columns whose values may all be numbers; those sort as numbers. Values of mixed kind sort
    as numbers, and text by itself.
    """
    order: list[Column] = []
    for name, descending in keys:
        if name in df.columns and isinstance(df.schema[name].dataType, T.VariantType):
            parts = [mixed.number(col(name)), mixed.plain_text(col(name))]
        else:
            parts = [text.to_number(col(name)), col(name)] if name in by_number else [col(name)]
        order.extend(p.desc_nulls_first() if descending else p.asc_nulls_first() for p in parts)
    return df.orderBy(*order) if order else df


def _round_fractions(df: DataFrame, but: tuple[str, ...]) -> DataFrame:
    fractions = [
        f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in but
    ]
    return df.withColumns({n: F.round(col(n), GROUPED_DIGITS) for n in fractions})


def lay_out(df: DataFrame, spec: ReportSpec) -> DataFrame:
    """Columns in the order of `keys_result`, rounded if grouped, under their headers."""
    shown = headers(spec)
    absent = [c for c, _ in shown if c not in df.columns]
    if absent:
        raise SpecError(f"the report has no column {absent}")
    df = df.select(*[col(c) for c in dict.fromkeys(c for c, _ in shown)])
    if spec.group_by:
        df = _round_fractions(df, spec.group_by)
    return df.select(*[col(c).alias(header) for c, header in shown])


def keeper(spark: SparkSession, folder: str) -> Keep:
    """Writes tables below a folder and reads them back."""

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def report(
    df: DataFrame, spec: ReportSpec | dict[str, Any], filtered: bool = False, loose: tuple[str, ...] = (), keep: Keep | None = None,
) -> DataFrame:
    """The report over any DataFrame that has the columns the specification names.

    `filtered` says that the filters have been applied already, `loose` names untyped property text. The result is lazy, unless
    `keep` may write intermediate tables (see `aggregate`).
    """
    if isinstance(spec, dict):
        spec = parse_spec(spec, from_files=False)
    if not filtered:
        df = keep_rows(df, list(spec.filters), loose)
    df = apply_times(df, spec)
    if spec.grouped:
        df = settle_mixed(df, spec)
        df = aggregate(df, list(spec.group_by), spec.measures, keep)
    return finish(df, spec, loose)


def finish(df: DataFrame, spec: ReportSpec, loose: tuple[str, ...] = ()) -> DataFrame:
    """The report from its groups or rows: formulas, sorting, limit, layout."""
    df = add_formulas(df, spec.formulas)
    unknown = [name for name, _ in spec.sort if name not in df.columns]
    if unknown:
        raise SpecError(f"cannot sort by {unknown}: no such column")
    df = sort_rows(df, spec.sort, loose)
    if spec.limit > 0:
        df = df.limit(spec.limit)
    return lay_out(df, spec)


def first_rows(events: DataFrame, spec: ReportSpec, loose: tuple[str, ...], keep: Keep) -> DataFrame:
    """Those of the staged events that a sorted, limited listing shows.

    They are found by their sort keys and places alone; their texts are then read from the files that hold them.
    """
    shaped = add_formulas(apply_times(events, spec), spec.formulas)
    by = [name for name, _ in spec.sort]
    if not set(by) <= set(shaped.columns):
        return events.drop(*PLACE)  # the report tells what is wrong
    places = sort_rows(shaped.select(*[col(c) for c in dict.fromkeys([*by, *PLACE])]), spec.sort, loose).limit(spec.limit).select(*PLACE)
    chosen = keep(places)
    files = [r[0] for r in chosen.select(PLACE[0]).distinct().limit(NAMED_PATHS + 1).collect()]
    if len(files) <= NAMED_PATHS:
        events = events.where(F.col(PLACE[0]).isin(files))
    return events.join(chosen, list(PLACE), "left_semi").drop(*PLACE)


def report_lines(
    lines: DataFrame, spec: ReportSpec | dict[str, Any], in_file_order: bool = False,
    encoding: str | None = "auto", stage: str | None = None, watch: Watch | None = None,
) -> DataFrame:
    """The report over log lines: frame, extract, filter, then `report`. A `watch` counts what is left out; it needs a `stage`."""
    if isinstance(spec, dict):
        spec = parse_spec(spec, from_files=False)
    wanted = event_columns(spec)
    late = bool(stage) and not spec.grouped and spec.limit > 0 and bool(spec.sort)
    events = log_events(
        lines, wanted, spec.event_name, spec.start, spec.end, in_file_order, encoding, stage, watch, located=late
    )
    loose = tuple(k for k in wanted.properties if k not in wanted.types)
    keep = keeper(lines.sparkSession, f"{stage}/_kept") if stage else None
    if late:
        events = first_rows(events, spec, loose, keep)
    return report(events, spec, filtered=True, loose=loose, keep=keep)


def run_report(
    spark: SparkSession, definition: dict[str, Any], stage: bool = True, encoding: str | None = "auto",
    folder: str | None = None, watch: Watch | None = None,
) -> DataFrame:
    """The report over log files.

    With `stage` the log is read once, when this is called, and its wanted events are kept as Parquet
    in `folder`, or a new one under the cluster's shared folder; the report is computed from there, and
    the caller removes the folder when the report is no longer needed (`write_report` does so). Without
    `stage` the result is one lazy plan that reads the log for every branch.

    With a `watch` the same reading also counts what is left out (see `Watch`), and files whose names hold no hour are
    warned about; `skipped` lists all files that are passed over.
    """
    spec = parse_spec(definition)
    if watch is not None:
        _warn_of_bad_names(skipped(spark, spec))
    lines = read_lines(
        spark, list(spec.base_directories), list(spec.base_subdirectories or ()), spec.start, spec.end
    )
    stage_at = (folder or scratch_folder(spark)) if stage else None
    return report_lines(lines, spec, in_file_order=True, encoding=encoding, stage=stage_at, watch=watch)


def reports_together(
    lines: DataFrame, specs: list[ReportSpec | dict[str, Any]], stage: str, in_file_order: bool = False, encoding: str | None = "auto",
) -> list[DataFrame]:
    """Several reports over the same log lines, which are read once; `report_lines` gives each of them alone."""
    parsed = [parse_spec(s, from_files=False) if isinstance(s, dict) else s for s in specs]
    wants = [Wanted(event_columns(s), s.event_name, s.start, s.end) for s in parsed]
    made = []
    for spec, want, events in zip(parsed, wants, events_of_all(lines, wants, stage, in_file_order, encoding)):
        loose = tuple(k for k in want.columns.properties if k not in want.columns.types)
        made.append(report(events, spec, filtered=True, loose=loose, keep=keeper(lines.sparkSession, f"{stage}/_kept")))
    return made


def run_reports(
    spark: SparkSession, definitions: list[dict[str, Any]], encoding: str | None = "auto", folder: str | None = None,
) -> list[DataFrame]:
    """Several reports over log files, in the order of their specifications.

    Reports over the same directories are made from one reading of the files in all their periods; their events are kept as Parquet below `folder`, or a new one
    under the cluster's shared folder.
    """
    specs = [parse_spec(d) for d in definitions]
    groups: dict[tuple, list[int]] = {}
    for i, s in enumerate(specs):
        groups.setdefault((s.base_directories, s.base_subdirectories), []).append(i)
    made: dict[int, DataFrame] = {}
    folder = folder or scratch_folder(spark)
    for n, ((directories, subdirectories), members) in enumerate(groups.items()):
        mine = [specs[i] for i in members]
        start, end = whole_period([Wanted(event_columns(s), s.event_name, s.start, s.end) for s in mine])
        lines = read_lines(spark, list(directories), list(subdirectories or ()), start, end)
        made.update(zip(members, reports_together(lines, mine, f"{folder}/{n}", in_file_order=True, encoding=encoding)))
    return [made[i] for i in range(len(specs))]


def skipped(spark: SparkSession, spec: ReportSpec | dict[str, Any]) -> DataFrame:
    """`(path, length, reason)` of the log files in the report's directories that it does not read; nothing is opened for this."""
    if isinstance(spec, dict):
        spec = parse_spec(spec)
    return list_skipped_files(spark, list(spec.base_directories), list(spec.base_subdirectories or ()), spec.start, spec.end)


def _warn_of_bad_names(files: DataFrame) -> None:
    bad = files.where("reason = 'name'")
    named = [r["path"] for r in bad.orderBy("path").limit(NAMED_FILES).collect()]
    if named:
        log.warning("%d files have no hour in their names and are skipped: %s", bad.count(), ", ".join(named))
