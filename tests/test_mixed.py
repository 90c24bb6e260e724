"""Values of mixed kind: kept, filtered, sorted, calculated with, written."""

from __future__ import annotations

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from logloom.functions import mixed
from logloom.operators.filters import Filter, keep_rows
from logloom.plans.report import report, run_report, sort_rows
from logloom.plans.spec import parse_spec
from logloom.sinks import write_table

VALUES = ["5", "5.0", "5e0", "-0.5", ".25", "007", "9" * 25, "1e999", "abc", "NaN", "1d", "0x1F", "", " ", "5 apples", "true", "2024-01-01", "日本", None]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, v) for i, v in enumerate(VALUES)]
    return spark.createDataFrame(rows, "n int, raw string").withColumn("v", mixed.from_text(F.col("raw")))


def test_kinds(table):
    made = {r["raw"]: r for r in table.select("raw", F.schema_of_variant("v").alias("kind"), mixed.number(F.col("v")).alias("number"), mixed.plain_text(F.col("v")).alias("text"), mixed.shown(F.col("v")).alias("shown")).collect()}
    for raw, whole in {"5": 5, "5.0": 5, "5e0": 5, "007": 7}.items():
        assert (made[raw]["kind"], made[raw]["number"], made[raw]["shown"], made[raw]["text"]) == ("BIGINT", whole, str(whole), None)
    for raw, value in {"-0.5": -0.5, ".25": 0.25, "9" * 25: 1e25, "1e999": float("inf")}.items():
        assert (made[raw]["kind"], made[raw]["number"], made[raw]["text"]) == ("DOUBLE", value, None)
    for raw in VALUES[8:-1]:
        assert (made[raw]["kind"], made[raw]["number"], made[raw]["shown"], made[raw]["text"]) == ("STRING", None, raw, raw)
    assert tuple(made[None])[1:] == (None, None, None, None)


def value_of(raw):
    """What a property's text counts as."""
    if raw is None:
        return None
    try:
        number = float(raw)
    except ValueError:
        return raw
    return raw if raw in ("NaN",) else number


@pytest.mark.parametrize("operation, bound", [
    (o, b) for o in ("eq", "ne") for b in (5, 5.0, "5", "abc", True, None, [1])
] + [(o, b) for o in ("gt", "ge", "lt", "le") for b in (5, "5", 0.25, "abc", None)] + [("contains", "a"), ("contains", "5"), ("regex", "^[0-9]"), ("regex", "a.c"), ("filled", None), ("empty", None)])
def test_filters(table, operation, bound):
    def keeps(raw):
        value = value_of(raw)
        if operation in ("filled", "empty"):
            blank = value is None or isinstance(value, str) and not value.strip()
            return blank == (operation == "empty")
        if value is None:
            return False
        if operation in ("eq", "ne"):
            return (value == bound) == (operation == "eq")
        if operation in ("gt", "ge", "lt", "le"):
            if isinstance(value, str) or bound in ("abc", None):
                return False
            return {"gt": value > float(bound), "ge": value >= float(bound), "lt": value < float(bound), "le": value <= float(bound)}[operation]
        if not isinstance(value, str):
            return False
        import re

        return bound in value if operation == "contains" else bool(re.search(bound, value))

    got = {r["raw"] for r in keep_rows(table, [Filter("v", operation, bound)]).collect()}
    assert got == {raw for raw in VALUES if keeps(raw)}


def test_sorting(table):
    rows = [r["raw"] for r in sort_rows(table.where("n < 12 AND n NOT IN (1, 2)"), (("v", False),)).collect()]
    assert rows == ["0x1F", "1d", "NaN", "abc", "-0.5", ".25", "5", "007", "9" * 25, "1e999"]
    rows = [r["raw"] for r in sort_rows(table.where("n < 12 AND n NOT IN (1, 2)"), (("v", True),)).collect()]
    assert rows == ["abc", "NaN", "1d", "0x1F", "1e999", "9" * 25, "007", "5", ".25", "-0.5"]


def test_conditions_reach_the_scan(spark, table, tmp_path):
    path = str(tmp_path / "t")
    table.write.parquet(path)
    plan = keep_rows(spark.read.parquet(path), [Filter("v", "gt", 3)])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v." in plan
    assert keep_rows(spark.read.parquet(path), [Filter("v", "gt", 3)]).count() == 6


def test_types_of_a_specification():
    keys = [{"name": "a"}, {"name": "x", "formula": "a * b"}]
    assert parse_spec({"keys_result": keys}, False).property_types == {"a": "mixed", "b": "mixed"}
    grouped = [{"name": "k"}, {"name": "a", "aggregation": ["sum"]}]
    assert parse_spec({"keys_result": grouped, "keys_aggregate": "k"}, False).property_types == {"a": "double"}


def test_grouped_report(table):
    keys = [{"name": "v"}, {"name": "n", "aggregation": ["min"]}]
    rows = {r["v"]: r["n (min)"] for r in report(table, {"keys_result": keys, "keys_aggregate": "v"}).collect()}
    assert rows["5"] == 0 and rows["7"] == 5 and rows["abc"] == 8 and len(rows) == len(VALUES) - 2
    keys = [{"name": "n"}, {"name": "v", "aggregation": ["sum", "max"]}]
    rows = {r["n"]: r for r in report(table.where("n < 10"), {"keys_result": keys, "keys_aggregate": "n"}).collect()}
    assert rows[3]["v (sum)"] == -0.5 and rows[8]["v (max)"] is None


LOG = "\n".join(f"00:0{i}.1-{i},CALL,1,Usr=u{i},Rows={v}" for i, v in enumerate(["12", "12.50", "many", "0", "'1,5'"]))


def test_listing_over_files(spark, tmp_path):
    folder = tmp_path / "base" / "rphost_1"
    folder.mkdir(parents=True)
    (folder / "24010112.log").write_text(LOG)
    definition = {
        "logger_directory": "", "logger_file": "", "base_directories": [str(tmp_path / "base")], "base_subdirectories": ["rphost_1"], "output_directory": "",
        "output_file": "", "start_period": "240101000000", "end_period": "240102000000", "event_name": "CALL", "event_limit": 0, "keys_aggregate": "",
        "keys_sort": "Rows asc", "cpu_usage_percent": 50,
        "keys_result": [{"name": "Usr"}, {"name": "Rows"}, {"name": "half", "formula": "Rows / 2"}],
    }
    made = run_report(spark, definition)
    shown = [(r["Usr"], r["rows"], r["half"]) for r in made.select("Usr", mixed.shown(F.col("Rows")).alias("rows"), "half").collect()]
    assert shown == [("u4", "1,5", None), ("u2", "many", None), ("u3", "0", 0.0), ("u0", "12", 6.0), ("u1", "12.5", 6.25)]
    (part,) = glob.glob(write_table(made.coalesce(1), str(tmp_path / "out.csv")) + "/part-*")
    assert [r["Rows"] for r in csv.DictReader(open(part, encoding="utf-8"))] == ["1,5", "many", "0", "12", "12.5"]
    (part,) = glob.glob(write_table(made.coalesce(1), str(tmp_path / "out.json"), "json") + "/part-*")
    assert [json.loads(line)["Rows"] for line in open(part, encoding="utf-8")] == ["1,5", "many", 0, 12, 12.5]
    back = spark.read.parquet(write_table(made, str(tmp_path / "out.parquet"), "parquet"))
    assert back.where(F.schema_of_variant("Rows") == "STRING").count() == 2
