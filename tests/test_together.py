"""Several reports from one reading of the log."""

from __future__ import annotations

import random
import shutil

import pytest

from logloom.plans.report import reports_together, run_report, run_reports
from logloom.sinks import write_reports
from logloom.sources.events import EventColumns, log_events
from logloom.sources.lines import LINES_SCHEMA
from logloom.sources.shared import Wanted, all_names, events_of_all, whole_period

BASE = {
    "logger_directory": "", "logger_file": "", "base_subdirectories": ["rphost_1"], "output_directory": "", "output_file": "", "start_period": "240101000000",
    "end_period": "240102000000", "event_limit": 0, "keys_aggregate": "", "keys_sort": "", "cpu_usage_percent": 50,
}
REPORTS = [
    {"event_name": "CALL", "keys_aggregate": "Usr", "keys_sort": "Usr", "keys_result": [{"name": "Usr"}, {"name": "Memory", "aggregation": ["sum", "p95"]}]},
    {"event_name": "CALL", "keys_sort": "duration desc", "event_limit": 5, "keys_result": [{"name": "Inner"}, {"name": "duration"}]},
    {"event_name": "CALL", "keys_sort": "duration desc", "keys_result": [{"name": "Note"}, {"name": "Inner"}, {"name": "duration"}, {"name": "lastcontext"}]},
    {"event_name": "EXCP", "keys_sort": "timestamp", "start_period": "240101120500", "end_period": "240101125500", "keys_result": [{"name": "timestamp"}, {"name": "Memory"}, {"name": "half", "formula": "Memory / 2"}],
     "keys_filters": [{"key": "Memory", "operation": "gt", "value": 300}, {"key": "Name", "operation": "eq", "value": "EXCP"}, {"key": "Usr", "operation": "filled"}]},
    {"event_name": "SDBL", "keys_result": [{"name": "duration"}]},
    {"event_name": "CALL", "base_subdirectories": ["rphost_2"], "keys_aggregate": "Usr", "keys_result": [{"name": "Usr"}, {"name": "count", "aggregation": ["sum"]}]},
]


def log_text(seed, n=80):
    rnd, lines = random.Random(seed), ["stray"]
    for i in range(n):
        memory = rnd.choice(["", f",Memory={rnd.randint(0, 900)}", ",Memory=many"])
        note = rnd.choice(["", f",Note='x ,Inner=in{i}, y'", f",Inner=out{i}"])
        lines.append(f"{i % 60:02d}:{rnd.randint(0, 59):02d}.{i + 100000}-{rnd.randint(1, 10**8)},{rnd.choice(['CALL', 'EXCP', 'CALLX'])},1,Usr=u{rnd.randint(0, 3)}{memory}{note},Context='a{i}")
        lines.append(f"  b{i % 5}'")
    return "\n".join(lines)


@pytest.fixture
def definitions(tmp_path):
    for n in (1, 2):
        folder = tmp_path / "base" / f"rphost_{n}"
        folder.mkdir(parents=True)
        for hour in ("24010111", "24010112"):
            (folder / f"{hour}.log").write_text(log_text(f"{n}{hour}"))
    return [{**BASE, "base_directories": [str(tmp_path / "base")], **r} for r in REPORTS]


def shown(df):
    return df.columns, [tuple(str(v) for v in r) for r in df.collect()]


def test_same_as_one_by_one(spark, definitions, tmp_path):
    want = [shown(run_report(spark, d)) for d in definitions]
    assert [len(rows) > 0 for _, rows in want] == [True] * 4 + [False, True]
    made = run_reports(spark, definitions)
    # the log has been read, and once
    shutil.rmtree(tmp_path / "base")
    for got, (columns, rows) in zip(made, want):
        assert "FileScan text" not in got._jdf.queryExecution().executedPlan().toString()
        got_columns, got_rows = shown(got)
        assert got_columns == columns and sorted(got_rows) == sorted(rows)


def test_one_scan(spark, definitions, tmp_path, monkeypatch):
    """Reports over the same directories share one scan, whatever they want from it."""
    import logloom.plans.report as plan

    scans = []
    monkeypatch.setattr(plan, "read_lines", lambda *a, real=plan.read_lines, **k: scans.append(a[2]) or real(*a, **k))
    paths = write_reports(spark, [{**d, "output_directory": str(tmp_path / "out"), "output_file": f"r{i}"} for i, d in enumerate(definitions)], "parquet")
    assert scans == [["rphost_1"], ["rphost_2"]]
    assert [spark.read.parquet(p).count() for p in paths] == [run_report(spark, d).count() for d in definitions]
    with pytest.raises(ValueError, match="same place"):
        write_reports(spark, definitions[:2])


@pytest.mark.parametrize("size", [1, 5])
def test_events_across_borders(spark, tmp_path, size):
    text = log_text("x", 40).split("\n")
    rows = [("/x/24010112.log", i - i % size, i, False, v) for i, v in enumerate(text)]
    lines = spark.createDataFrame(rows, LINES_SCHEMA)
    columns = [EventColumns(["Inner", "duration"]), EventColumns(["Usr", "lastcontext"], types={"Usr": "double"}), EventColumns(["Memory"], types={"Memory": "mixed"}), EventColumns([])]
    wants = [Wanted(c, n) for c, n in zip(columns, ("CALL", "CALL", "EXCP", None))]
    for got, w in zip(events_of_all(lines, wants, str(tmp_path / "s")), wants):
        alone = log_events(lines, w.columns, w.event_name)
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in alone.schema]
        assert sorted(map(str, got.collect())) == sorted(map(str, alone.collect())) != []


def test_what_all_want_together():
    from datetime import datetime

    a, b = datetime(2024, 1, 1), datetime(2024, 1, 2)
    none = EventColumns([])
    assert all_names([Wanted(none, "A"), Wanted(none, "B"), Wanted(none, "A")]) == ("A", "B") and all_names([Wanted(none, "A"), Wanted(none)]) is None
    assert whole_period([Wanted(none, "A", a, a), Wanted(none, "A", b, b)]) == (a, b) and whole_period([Wanted(none, "A", a), Wanted(none, "A", None, b)]) == (None, None)


def test_no_lines(spark, tmp_path):
    lines = spark.createDataFrame([], LINES_SCHEMA)
    made = reports_together(lines, [{"event_name": "CALL", "keys_result": [{"name": "Usr"}]}, {"event_name": "EXCP", "keys_result": [{"name": "duration"}]}], str(tmp_path / "s"))
    assert [m.count() for m in made] == [0, 0] and [m.columns for m in made] == [["Usr"], ["duration"]]
