"""Specifications, layout, whole reports over log files, writing."""

from __future__ import annotations

import csv
import glob
from datetime import datetime

import pytest

from logloom.plans import presets
from logloom.plans.report import report, run_report
from logloom.plans.spec import REQUIRED, SpecError, headers, parse_spec
from logloom.sinks import write_report, write_table


def spec(**more):
    return {
        "keys_result": [{"name": "k"}, {"name": "v", "alias": "V", "aggregation": ["sum"]}],
        "keys_aggregate": "k", **more,
    }


# ---- specifications ------------------------------------------------------------------------------


def test_required_keys():
    full = presets.over(presets.top_calls(), start_period="240101000000", end_period="240102000000")
    parse_spec(full)
    for key in REQUIRED:
        with pytest.raises(SpecError, match=key):
            parse_spec({k: v for k, v in full.items() if k != key})
    parse_spec({k: v for k, v in full.items() if k != "keys_filters"})


@pytest.mark.parametrize("more, message", [
    ({"start_period": "2401010000"}, "period"), ({"end_period": "249901000000"}, "period"), ({"event_name": "CALL2"}, "letters"),
    ({"keys_result": [{"name": "v", "aggregation": ["avg"]}]}, "unknown aggregate"), ({"keys_result": []}, "empty"),
    ({"keys_result": [{"alias": "x"}]}, "no name"), ({"keys_result": [{"name": "t", "roundtime": "5x"}]}, "bucket"),
    ({"keys_result": [{"name": "x", "formula": "a +"}]}, "formula"), ({"keys_filters": [{"key": "a", "operation": "~"}]}, "filter 1"),
    ({"keys_result": [{"name": "k"}, {"name": "plain"}, {"name": "v", "aggregation": ["sum"]}]}, "plain"),
    ({"keys_result": [{"name": "k", "alias": "A"}, {"name": "v", "alias": "A", "aggregation": ["min"]}, {"name": "w", "alias": "A", "aggregation": ["min"]}]}, "header"),
    ({"keys_result": [{"name": "v", "aggregation": ["intervals_2_2", "intervals_2_3"]}]}, "header"),
])
def test_bad_specifications(more, message):
    with pytest.raises(SpecError, match=message):
        parse_spec(spec(**more), from_files=False)


def test_sort_words():
    assert parse_spec(spec(keys_sort="a, b DESC,c asc ,p:x down, e desc last"), False).sort == (
        ("a", False), ("b", True), ("c", False), ("p:x", True), ("e", False),
    )
    assert parse_spec(spec(keys_sort=""), False).sort == ()


def test_headers():
    keys = [
        {"name": "timestamp", "alias": "T", "aggregation": ["roundtime_5m"]},
        {"name": "d", "alias": "D", "aggregation": ["percent", "sum", "intervals_3_1", "p95"]},
        {"name": "x", "formula": "d / 2"},
    ]
    grouped = parse_spec({"keys_result": keys, "keys_aggregate": "timestamp"}, False)
    assert [h for _, h in headers(grouped)] == [
        "T (round 5m)", "D (% влияния)", "D (sum)", "D (<3)", "D (3>)", "D (P95)", "x",
    ]
    listing = parse_spec({"keys_result": [*keys[:2], {"name": "m", "alias": "M", "aggregation": ["mean"]}]}, False)
    assert headers(listing) == [("timestamp", "T (round 5m)"), ("d", "D (sum)"), ("m", "M")]


# ---- reports over a DataFrame --------------------------------------------------------------------


@pytest.fixture(scope="module")
def frame(spark):
    rows = [("a", 1.005, 1), ("a", 2.0, 2), ("b", 4.1239, 3), (None, 0.5, 4)]
    return spark.createDataFrame(rows, "k string, v double, n bigint")


def test_grouped(frame):
    keys = [
        {"name": "v", "alias": "V", "aggregation": ["percent", "mean"]}, {"name": "k", "alias": "K", "aggregation": ["max"]},
        {"name": "n", "aggregation": ["sum"]}, {"name": "r", "formula": "v_mean / n"},
    ]
    made = report(frame, {"keys_result": keys, "keys_aggregate": "k", "keys_sort": "v_mean desc", "event_limit": 2})
    assert made.columns == ["V (% влияния)", "V (avg)", "K", "n (sum)", "r"]
    assert [tuple(r) for r in made.collect()] == [(54.06, 4.12, "b", 3, 1.38), (39.39, 1.5, "a", 3, 0.5)]


def test_grouping_needs_an_aggregate(frame):
    made = report(frame, {"keys_result": [{"name": "k"}, {"name": "v"}], "keys_aggregate": "k", "keys_sort": "v"})
    assert [r.v for r in made.collect()] == [0.5, 1.0, 2.0, 4.12] or [r.v for r in made.collect()] == [0.5, 1.01, 2.0, 4.12]
    blank = report(frame, {"keys_result": [{"name": "v"}], "keys_aggregate": "  "})
    assert blank.count() == 4


def test_listing_is_not_rounded_and_times_are(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 12:04:00' AS timestamp, 1.23456D AS v")
    keys = [{"name": "timestamp", "aggregation": ["roundtime_5m"]}, {"name": "v"}]
    assert report(df, {"keys_result": keys}).first() == (datetime(2024, 1, 1, 12, 0), 1.23456)
    nearest = report(df, {"keys_result": [{"name": "timestamp", "roundtime": "5m"}, {"name": "v"}]})
    assert nearest.first()[0] == datetime(2024, 1, 1, 12, 5)


def test_unknown_columns_are_named(frame):
    with pytest.raises(SpecError, match="nowhere"):
        report(frame, spec(keys_sort="nowhere desc"))
    with pytest.raises(SpecError, match="gone"):
        report(frame, {"keys_result": [{"name": "gone"}]})


def test_top_n_is_one_operator(frame):
    made = report(frame, spec(keys_sort="v desc", event_limit=1))
    assert "TakeOrderedAndProject" in made._jdf.queryExecution().executedPlan().toString()


# ---- reports over log files ----------------------------------------------------------------------

LOG = {
    "a/full/rphost_1/24010112.log": [
        "29:59.0-9000000,CALL,1,Usr=Ann,Memory=1,Context='early'",
        "30:01.0-1000000,CALL,1,Usr=Ann,Memory=1024,Context='Form.Open", "    Module.Run : 10", "    Module.Inner : 20'",
        "30:02.0-7,SCALL,1,Usr=Ann,Memory=5,Context='x'", "   not part of any call",
        "45:00.0-3000000,CALL,1,Usr=Bob,Memory=2048,Context='Form.Open", "    Module.Inner : 20'",
        "45:00.5-100,CALL,1,Usr=Bob,Memory=,Context='bare'", "45:01.0-100,CALL,1,Usr=Bob,Context='no memory'",
    ],
    "b/full/rphost_2/24010113.log": ["00:00.0-2000000,CALL,1,Usr=Ann,Memory=4096,Context='Привет, мир'"],
    "b/other/rphost_2/24010113.log": ["00:00.0-2000000,CALL,1,Usr=Out,Memory=4096,Context='elsewhere'"],
}


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    root = tmp_path_factory.mktemp("report")
    for name, lines in LOG.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes("\r\n".join(lines).encode("cp1251" if name.startswith("b/") else "utf-8"))
    return root


def file_spec(logs, preset, **more):
    return presets.over(
        preset, base_directories=[f"{logs}/a", f"{logs}/b"], base_subdirectories=["full"], output_directory=str(logs / "out"),
        output_file="top.xlsx", start_period="240101123000", end_period="240101130000", **more,
    )


@pytest.mark.parametrize("stage", [True, False])
def test_memory_by_user(spark, logs, stage):
    made = run_report(spark, file_spec(logs, presets.memory_by_user()), stage=stage)
    assert made.columns == ["User", "Memory, bytes (sum)", "Memory, bytes (max)", "Memory, bytes (avg)", "Count (sum)"]
    assert [tuple(r) for r in made.collect()] == [("Ann", 5120.0, 4096.0, 2560.0, 2), ("Bob", 2048.0, 2048.0, 2048.0, 2)]


def test_duration_by_context(spark, logs):
    made = run_report(spark, file_spec(logs, presets.duration_by_context())).collect()
    assert [tuple(r) for r in made] == [
        ("Module.Inner : 20", 4.0, 66.66, 2, 2.0), ("Привет, мир", 2.0, 33.33, 1, 2.0), ("bare", 0.0, 0.0, 1, 0.0),
        ("no memory", 0.0, 0.0, 1, 0.0),
    ]


def test_listing_with_filter(spark, logs):
    filters = [{"key": "Context", "operation": "contains", "value": "Inner"}, {"key": "Memory", "operation": "ge", "value": 2048}]
    made = run_report(spark, file_spec(logs, presets.locks("CALL"), keys_filters=filters)).collect()
    assert [tuple(r) for r in made] == [
        (datetime(2024, 1, 1, 12, 45), "rphost_1", "24010112.log", "Bob", "Form.Open\nModule.Inner : 20", 3.0)
    ]


def test_untyped_columns_sort_as_numbers(spark, logs):
    keys = [{"name": "Memory"}]
    made = run_report(spark, file_spec(logs, presets.locks("CALL"), keys_result=keys, keys_sort="Memory desc"))
    assert [r.Memory for r in made.collect()] == [None, "4096", "2048", "1024"]


def test_nothing_found(spark, logs):
    empty = run_report(spark, file_spec(logs, presets.time_series(), event_name="TLOCK"))
    assert empty.columns == ["Time (round 5m)", "Count (sum)", "Duration, s (avg)"] and empty.count() == 0
    nowhere = presets.over(file_spec(logs, presets.memory_by_user()), base_directories=["/no/such/place"])
    assert run_report(spark, nowhere).count() == 0


def test_write_report(spark, logs):
    path = write_report(spark, file_spec(logs, presets.locks("CALL")))
    assert path == f"{logs}/out/top"
    rows = [row for f in glob.glob(f"{path}/part-*.csv") for row in csv.reader(open(f, encoding="utf-8", newline=""))]
    assert rows[0] == ["Time", "Process", "File", "User", "Context", "Duration, s"]
    assert ["Form.Open\nModule.Inner : 20", "3.0"] in [r[4:] for r in rows]


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_other_formats(spark, frame, tmp_path, fmt):
    made = report(frame, spec(keys_result=[{"name": "k", "alias": "Имя, с"}, {"name": "v", "alias": "V", "aggregation": ["sum", "percent"]}]))
    back = spark.read.format(fmt).load(write_table(made, str(tmp_path / "t"), fmt))
    assert back.count() == 3 and set(back.columns) == {"Имя, с", "V (sum)", "V (% влияния)"}
    with pytest.raises(ValueError):
        write_table(made, str(tmp_path / "x"), "xlsx")


def test_job_entry(spark, logs, tmp_path, capsys):
    import json

    from logloom.__main__ import load_definition, main

    definition = file_spec(logs, presets.memory_by_user())
    definition.update(output_directory=str(tmp_path), output_file="Отчёт.xlsx")
    for encoding in ("utf-8", "utf-8-sig", "cp1251"):
        path = tmp_path / f"{encoding}.json"
        path.write_bytes(json.dumps(definition, ensure_ascii=False).encode(encoding))
        assert load_definition(str(path)) == definition
    assert main([str(path), "json"]) == 0
    assert capsys.readouterr().out.strip() == f"{tmp_path}/Отчёт"
    assert spark.read.json(f"{tmp_path}/Отчёт").count() == 2
    assert main([]) == 2


# ---- listings that fetch their texts late --------------------------------------------------------


def late_lines(spark, n=400):
    from logloom.sources.lines import LINES_SCHEMA

    rows = []
    for i in range(n):
        rows += [(f"/x/2401011{i % 3}.log", i - i % 7, 2 * i, False, f"{i % 60:02d}:01.{i}-{(i * 7919) % 1000},CALL,1,Usr=u{i},Memory={i % 11},Context='some long text {i}"), (f"/x/2401011{i % 3}.log", i - i % 7, 2 * i + 1, False, f"  end {i}'")]
    return spark.createDataFrame(rows, LINES_SCHEMA)


@pytest.mark.parametrize("sort, limit", [("Memory desc, Usr", 25), ("twice, Usr desc", 7), ("Usr", 1000), ("timestamp desc, Usr", 3)])
def test_late_texts_give_the_same_listing(spark, tmp_path, sort, limit):
    from logloom.plans.report import report_lines

    definition = {
        "event_name": "CALL", "event_limit": limit, "keys_sort": sort,
        "keys_result": [{"name": "Usr"}, {"name": "Context"}, {"name": "duration"}, {"name": "Memory"}, {"name": "timestamp", "roundtime": "5m"}, {"name": "twice", "formula": "duration * 2"}],
    }
    lines = late_lines(spark)
    whole = report_lines(lines, definition)
    late = report_lines(lines, definition, stage=str(tmp_path / "s"))
    assert [str(r) for r in late.collect()] == [str(r) for r in whole.collect()]
    assert late.count() == min(limit, 400)


def test_sort_carries_no_text(spark, tmp_path, monkeypatch):
    """Places are found without reading a text column, and texts come from the files that hold the rows shown."""
    import logloom.plans.report as plan

    asked = []

    def watched(*arguments, real=plan.keeper):
        keep = real(*arguments)
        return lambda df: asked.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df)

    monkeypatch.setattr(plan, "keeper", watched)
    definition = {"event_name": "CALL", "event_limit": 5, "keys_sort": "duration desc, Usr", "keys_result": [{"name": "Usr"}, {"name": "Context"}, {"name": "duration"}]}
    late = plan.report_lines(late_lines(spark), definition, stage=str(tmp_path / "s"))
    (found,) = asked
    assert "TakeOrderedAndProject" in found and "Context" not in found
    shown = late._jdf.queryExecution().executedPlan().toString()
    assert "Context" in shown and "file_path" in shown and late.count() == 5


def test_unknown_sort_column_of_a_staged_listing(spark, tmp_path):
    from logloom.plans.report import report_lines

    with pytest.raises(SpecError, match="cannot sort"):
        report_lines(late_lines(spark, 3), {"event_name": "CALL", "event_limit": 5, "keys_sort": "nothing", "keys_result": [{"name": "Usr"}]}, stage=str(tmp_path / "s"))
