"""Counts of what is left out, by the same reading that makes the report."""

from __future__ import annotations

import json
import logging

import pytest

from logloom.__main__ import main
from logloom.plans.report import run_report, skipped
from logloom.sinks import write_report
from logloom.sources.events import EventColumns, log_events
from logloom.sources.lines import LINES_SCHEMA
from logloom.sources.watch import COUNTED, Watch

DEFINITION = {
    "logger_directory": "", "logger_file": "", "base_subdirectories": ["rphost_1"], "output_directory": "", "output_file": "",
    "start_period": "240101000000", "end_period": "240102000000", "event_name": "CALL", "event_limit": 0, "keys_aggregate": "Usr", "keys_sort": "Usr",
    "cpu_usage_percent": 50, "keys_result": [{"name": "Usr"}, {"name": "Memory", "aggregation": ["sum"]}],
    "keys_filters": [{"key": "Memory", "operation": "gt", "value": 5}],
}
FIRST = ["stray", "lines", "00:01.1-5,CALL,1,Usr=a,Memory=9,Context='x", "more'", "00:02.1-5,CALL,1,Usr=a", "99:02.1-5,CALL,1,Usr=a,Memory=7", "99:03.1-5,EXCP,1,Usr=a"]
SECOND = ["00:05.1-5,EXCP,1,Usr=b,Memory=9", "00:06.1-5,CALL,1,Usr=b,Memory=2", "00:07.1-5,CALL,1,Usr=b,Memory=8"]
EXPECTED = {"lost_lines": 2, "untimed": 1, "malformed": 0, "incomplete": 1, "filtered": 1, "events": 2}


@pytest.fixture
def tree(tmp_path):
    folder = tmp_path / "base" / "rphost_1"
    folder.mkdir(parents=True)
    (folder / "24010112.log").write_text("\n".join(FIRST))
    (folder / "24010113.log").write_text("\n".join(SECOND))
    (folder / "24010313.log").write_text("\n".join(SECOND))
    (folder / "24010114.log").write_text("small")
    (folder / "nothour1.log").write_text("\n".join(SECOND))
    (folder / "24013214.log").write_text("\n".join(SECOND))
    return {**DEFINITION, "base_directories": [str(tmp_path / "base")]}


def test_report_with_counts(spark, tree, caplog):
    watch = Watch()
    with caplog.at_level(logging.WARNING):
        made = run_report(spark, tree, watch=watch)
    assert watch.counts() == EXPECTED and list(watch.counts()) == sorted(EXPECTED, key=COUNTED.index)
    assert [tuple(r) for r in made.collect()] == [tuple(r) for r in run_report(spark, tree).collect()] == [("a", 9.0), ("b", 8.0)]
    assert "2 files have no hour" in caplog.text and "nothour1.log" in caplog.text and "24013214.log" in caplog.text
    found = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in skipped(spark, tree).collect()}
    assert found == {"24010313.log": "period", "24010114.log": "size", "nothour1.log": "name", "24013214.log": "name"}


def test_one_reading(spark, tree, tmp_path):
    """The counts are there although the log is gone by then."""
    import shutil

    watch = Watch()
    made = run_report(spark, tree, watch=watch)
    shutil.rmtree(tmp_path / "base")
    assert watch.counts() == EXPECTED and made.count() == 2


def test_written_report_and_entry(spark, tree, tmp_path, capsys):
    watch = Watch()
    tree = {**tree, "output_directory": str(tmp_path / "out"), "output_file": "r.csv"}
    write_report(spark, tree, watch=watch)
    assert watch.counts() == EXPECTED
    (tmp_path / "spec.json").write_text(json.dumps(tree))
    assert main([str(tmp_path / "spec.json")]) == 0
    assert "lost_lines 2, untimed 1" in capsys.readouterr().err


def test_every_cut(spark, tmp_path):
    """However the lines are cut into splits, the counts are the same."""
    lines = [("/x/24010112.log", v) for v in FIRST] + [("/x/24010113.log", v) for v in ["stray", *SECOND]] + [("/x/24010114.log", "only"), ("/x/24010114.log", "stray")]
    columns = EventColumns(keys=["Usr", "Memory"])
    want = {**EXPECTED, "lost_lines": 5, "filtered": 0, "events": 3}
    for size in (1, 2, 3, 100):
        rows = [(path, i - i % size, i, False, v) for i, (path, v) in enumerate(lines)]
        watch = Watch()
        made = log_events(spark.createDataFrame(rows, LINES_SCHEMA).repartition(3), columns, "CALL", stage=str(tmp_path / f"s{size}"), watch=watch)
        assert watch.counts() == want and made.count() == 3
    whole = [(path, 0, i, True, v) for i, (path, v) in enumerate(lines)]
    watch = Watch()
    log_events(spark.createDataFrame(whole, LINES_SCHEMA), columns, "CALL", stage=str(tmp_path / "whole"), watch=watch)
    assert watch.counts() == want


def test_small_batches(spark, tmp_path, conf):
    """Lines before the first event that reach over several Arrow batches."""
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    rows = [("/x/24010112.log", 0, i, True, v) for i, v in enumerate([*["stray"] * 7, *FIRST, *SECOND])]
    watch = Watch()
    log_events(spark.createDataFrame(rows, LINES_SCHEMA).coalesce(1), EventColumns(keys=["Usr", "Memory"]), "CALL", stage=str(tmp_path / "s"), watch=watch)
    assert watch.counts() == {**EXPECTED, "lost_lines": 9, "filtered": 0, "events": 3}


def test_malformed_events_and_no_lines(spark, tmp_path):
    columns = EventColumns(keys=[])
    rows = [("/x/24010112.log", 0, i, True, v) for i, v in enumerate(["00:01.1-5,CALL,", "00:02.1-5,CALL,1"])]
    watch = Watch()
    log_events(spark.createDataFrame(rows, LINES_SCHEMA), columns, "CALL", stage=str(tmp_path / "a"), watch=watch)
    assert watch.counts() == {**dict.fromkeys(COUNTED, 0), "malformed": 1, "events": 1}
    watch = Watch()
    log_events(spark.createDataFrame([], LINES_SCHEMA), columns, "CALL", stage=str(tmp_path / "b"), watch=watch)
    assert watch.counts() == dict.fromkeys(COUNTED, 0)
    with pytest.raises(ValueError, match="staged"):
        log_events(spark.createDataFrame([], LINES_SCHEMA), columns, "CALL", watch=watch)
