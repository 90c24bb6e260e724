"""Report specifications: the declarative form, checked before anything runs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from logloom.functions.times import parse_bucket, parse_period
from logloom.operators.aggregates import Measure, check_aggregate, output_columns, roundtime_of
from logloom.operators.filters import Filter, load_filters
from logloom.operators.formulas import formula_names
from logloom.sources.events import BUILT_IN, TYPES

# Keys a specification over log files must have.
REQUIRED = (
    "logger_directory", "logger_file", "base_directories", "base_subdirectories", "output_directory",
    "output_file", "start_period", "end_period", "event_name", "event_limit", "keys_result",
    "keys_aggregate", "keys_sort", "cpu_usage_percent",
)


class SpecError(ValueError):
    """A report specification that cannot be run."""


@dataclass(frozen=True)
class ResultKey:
    """One entry of `keys_result`."""

    name: str
    alias: str
    aggregates: tuple[str, ...] = ()
    formula: str | None = None
    roundtime: str | None = None
    type: str | None = None


@dataclass(frozen=True)
class ReportSpec:
    keys: tuple[ResultKey, ...]
    group_by: tuple[str, ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()  # (internal name, descending)
    filters: tuple[Filter, ...] = ()
    limit: int = 0
    event_name: str | None = None
    start: datetime | None = None
    end: datetime | None = None
    base_directories: tuple[str, ...] = ()
    base_subdirectories: tuple[str, ...] | None = None
    output_directory: str | None = None
    output_file: str | None = None
    types: dict[str, str] = field(default_factory=dict)

    @property
    def measures(self) -> list[Measure]:
        """Aggregates of the columns that are not group keys."""
        return [Measure(k.name, k.aggregates) for k in self.keys if k.name not in self.group_by and k.aggregates]

    @property
    def grouped(self) -> bool:
        """Group keys alone do not group: at least one real aggregate is needed."""
        return bool(self.group_by) and any(not roundtime_of(a) for m in self.measures for a in m.aggregates)

    @property
    def formulas(self) -> dict[str, str]:
        return {k.name: k.formula for k in self.keys if k.formula}

    @property
    def property_types(self) -> dict[str, str]:
        """Declared types, and for every other column that is calculated with DOUBLE, or mixed where rows are listed as they are."""
        numeric = {m.column for m in self.measures if any(not roundtime_of(a) for a in m.aggregates)}
        for formula in self.formulas.values():
            numeric.update(formula_names(formula))
        numeric -= {*BUILT_IN, *self.group_by, *self.formulas}
        return {**{n: "double" if self.grouped else "mixed" for n in numeric}, **self.types}


def _result_key(entry: dict[str, Any]) -> ResultKey:
    name = entry.get("name")
    if not name:
        raise SpecError(f"an entry of keys_result has no name: {entry}")
    aggregates = tuple(entry.get("aggregation") or ())
    for a in aggregates:
        check_aggregate(a)
    if entry.get("roundtime"):
        parse_bucket(entry["roundtime"])
    if entry.get("formula") is not None:
        formula_names(entry["formula"])
    if entry.get("type") is not None and entry["type"] not in TYPES:
        raise SpecError(f"{name}: unknown type {entry['type']!r}, use one of {TYPES}")
    return ResultKey(
        name, entry.get("alias", name), aggregates, entry.get("formula"), entry.get("roundtime") or None,
        entry.get("type"),
    )


def _sort_keys(text: str) -> tuple[tuple[str, bool], ...]:
    words = [part.split() for part in (text or "").split(",") if part.strip()]
    return tuple((w[0], len(w) == 2 and w[1].lower() != "asc") for w in words)


def headers(spec: ReportSpec) -> list[tuple[str, str]]:
    """(internal column, header) in report order."""
    made: list[tuple[str, str]] = []
    for key in spec.keys:
        shown = {}
        for a in key.aggregates:
            columns = output_columns(key.name, a)
            in_place = list(columns) == [key.name]
            if spec.grouped and key.name not in spec.group_by:
                shown.update(columns)
            elif in_place:
                # nothing was aggregated: only aggregates that keep the plain name have a column
                shown.update(columns)
        if not shown:
            shown = {key.name: ""}
        made.extend((column, key.alias + suffix) for column, suffix in shown.items())
    return made


def _check(spec: ReportSpec) -> None:
    if not spec.keys:
        raise SpecError("keys_result is empty")
    if spec.event_name is not None and not re.fullmatch("[A-Za-z]+", spec.event_name):
        raise SpecError(f"event_name must be letters only: {spec.event_name!r}")
    if spec.grouped:
        for key in spec.keys:
            real = [a for a in key.aggregates if not roundtime_of(a)]
            if key.name not in spec.group_by and not real and not key.formula:
                raise SpecError(f"column {key.name!r} is neither grouped by nor aggregated")
    names = [header for _, header in headers(spec)]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise SpecError(f"several columns would have the header {twice}")


def parse_spec(definition: dict[str, Any], from_files: bool = True) -> ReportSpec:
    """Check a specification and bring it into its typed form; raises SpecError.

    Over log files all of REQUIRED must be present. Over a DataFrame only `keys_result` must. Process
    count and application-log keys are accepted and have no effect.
    """
    missing = [k for k in (REQUIRED if from_files else ("keys_result",)) if k not in definition]
    if missing:
        raise SpecError(f"missing keys: {', '.join(missing)}")
    d = definition
    try:
        keys = tuple(_result_key(entry) for entry in d["keys_result"])
        subdirs = d.get("base_subdirectories")
        spec = ReportSpec(
            keys=keys,
            group_by=tuple(k.strip() for k in (d.get("keys_aggregate") or "").split(",") if k.strip()),
            sort=_sort_keys(d.get("keys_sort") or ""),
            filters=tuple(load_filters(d.get("keys_filters"))),
            limit=int(d.get("event_limit") or 0),
            event_name=d.get("event_name") or None,
            start=parse_period(d["start_period"]) if d.get("start_period") else None,
            end=parse_period(d["end_period"]) if d.get("end_period") else None,
            base_directories=tuple(d.get("base_directories") or ()),
            base_subdirectories=None if subdirs is None else tuple(subdirs),
            output_directory=d.get("output_directory"),
            output_file=d.get("output_file"),
            types={k.name: k.type for k in keys if k.type},
        )
        if from_files and not (spec.start and spec.end and spec.event_name):
            raise SpecError("start_period, end_period and event_name must be filled")
        _check(spec)
    except SpecError:
        raise
    except (ValueError, TypeError) as error:
        raise SpecError(str(error)) from error
    return spec
