"""Properties of single events: the edge cases of the log format."""

from __future__ import annotations

from datetime import datetime

import pytest

from logloom.functions.text import normalize_sql
from logloom.operators.filters import load_filters
from logloom.sources.events import EventColumns, log_events
from logloom.sources.lines import LINES_SCHEMA


def events(spark, text, columns, name="CALL", **options):
    rows = [("/logs/full/rphost_1/24010112.log", 0, i, True, v) for i, v in enumerate(text.split("\n"))]
    return log_events(spark.createDataFrame(rows, LINES_SCHEMA), columns, name, **options)


def one(spark, line, *keys, **options):
    got = events(spark, line, EventColumns(keys=list(keys), **options)).collect()
    return got[0] if got else None


def test_built_in_columns(spark):
    row = one(spark, "05:07.123456-2500000,CALL,1,Usr=A", "Usr")
    assert row.timestamp == datetime(2024, 1, 1, 12, 5, 7)
    assert (row.Name, row["count"], row.duration) == ("CALL", 1, 2.5)
    assert (row.filename, row.processname, row.Usr) == ("24010112.log", "rphost_1", "A")


@pytest.mark.parametrize("line, keys, expected", [
    ("Usr=A,x=1,Usr=B", ["Usr"], ["B"]),
    ("Usr=,x=1", ["Usr"], [None]),
    ('Usr="",x=1', ["Usr"], ['""']),
    ("Usr='',x=1", ["Usr"], ["''"]),
    ('Sql="x ,Usr=inner",Usr=out', ["Sql", "Usr"], ["x ,Usr=inner", "out"]),
    ('Note="x ,Usr=inner"', ["Usr"], ['inner"']),
    ('Note="say ""hi"" now"', ["Note"], ['say ""hi"" now']),
    ("Note='say \"hi\", you'", ["Note"], ['say "hi", you']),
    ('Usr="open', ["Usr"], ['"open']),
    ('Usr="  spaced  "', ["Usr"], ["spaced"]),
    ("p:processName=base,processName=other", ["p:processName"], ["base"]),
    ("Memory=5,MemoryPeak=6", ["MemoryPeak", "Memory"], ["6", "5"]),
    ("a.b=1,axb=2", ["a.b"], ["1"]),
])
def test_property_values(spark, line, keys, expected):
    row = one(spark, f"00:01.1-5,CALL,1,{line}", *keys)
    assert [row[k] for k in keys] == expected


def test_first_slot_is_not_a_property(spark):
    assert one(spark, "00:01.1-5,CALL,Usr=A,Usr=", "Usr").Usr is None


def test_required_properties(spark):
    assert one(spark, "00:01.1-5,CALL,1,x=1", "Usr") is None
    assert one(spark, "00:01.1-5,CALL,1,x=1", "Usr", require_all=False).Usr is None
    row = one(spark, "00:01.1-5,CALL,1,x=1", "x", extra=["Usr"])
    assert (row.x, row.Usr) == ("1", None)


def test_names_of_letters_only(spark):
    assert events(spark, "00:01.1-5,CALL2,1,x=1", EventColumns(keys=["x"]), "CALL2").count() == 0


def test_lines_and_last_context(spark):
    text = "00:01.1-5,CALL,1,Context='Form.Open\n    Module.Run : 10\n\t  Module.Inner : 20  '"
    row = one(spark, text, "Context", "lastcontext")
    assert row.Context == "Form.Open\nModule.Run : 10\nModule.Inner : 20"
    assert row.lastcontext == "Module.Inner : 20"
    alone = one(spark, "00:01.1-5,CALL,1,x=1", "lastcontext", "x", require_all=False)
    assert alone.lastcontext is None


@pytest.mark.parametrize("text, as_double, as_bigint", [
    ("12", 12.0, 12), ("-3.50", -3.5, None), ("5.0", 5.0, 5), ("1e3", 1000.0, 1000), (".5", 0.5, None),
    ("1_000", None, None), ("12d", None, None), ("nan", None, None), ("inf", None, None), ("x", None, None),
    ("9007199254740993", 9007199254740992.0, 9007199254740993),
])
def test_numbers(spark, text, as_double, as_bigint):
    line = f"00:01.1-5,CALL,1,M={text}"
    assert one(spark, line, "M", types={"M": "double"}).M == as_double
    assert one(spark, line, "M", types={"M": "bigint"}).M == as_bigint
    assert one(spark, line, "M").M == text


@pytest.mark.parametrize("text, expected", [
    ("SELECT a FROM pg_temp.tt28 WHERE b = 'x' AND c = 12", "SELECT a FROM pg_temp_table WHERE b = _PARAM_ AND c = _PARAM_"),
    (r"x = '\\x00ff'::bytea AND y=1.25", "x = _PARAM_ AND y=_PARAM_"),
    ("t > '2024-01-02 03:04:05'::timestamp", "t > _PARAM_"),
    ("INSERT INTO pg_temp.tt1 VALUES (1, 'a', pg_temp.tt2)", "INSERT INTO pg_temp_table pg_temp_table"),
    ("INSERT INTO t1 VALUES  (1, 'a b', 3)", "INSERT INTO t1 _PARAM_"),
    ("n = 'имя' AND m = 'two words' AND k = ''", "n = _PARAM_ AND m = 'two words' AND k = _PARAM_"),
    ("a1 = b2 + 3", "a1 = b2 + _PARAM_"),
])
def test_normalize_sql(spark, text, expected):
    from pyspark.sql import functions as F

    assert spark.range(1).select(normalize_sql(F.lit(text)).alias("s")).first().s == expected


def test_sql_property_is_normalised(spark):
    row = one(spark, "00:01.1-5,DBMSSQL,1,x=1", "x")
    assert row is None
    rows = events(
        spark, "00:02.5-9,DBMSSQL,3,Sql=\"SELECT a FROM pg_temp.tt28 WHERE b = 'x' AND c = 12\",Rows=3",
        EventColumns(keys=["Sql", "Rows"]), "DBMSSQL",
    ).collect()
    assert rows[0].Sql == "SELECT a FROM pg_temp_table WHERE b = _PARAM_ AND c = _PARAM_"


def test_filters_decide_number_or_text_by_value(spark):
    text = "\n".join(f"00:0{i}.1-5,CALL,1,Id={v}" for i, v in enumerate(["12", "12.0", "x12", "13", ""]))

    def kept(operation, value=None):
        filters = load_filters([{"key": "Id", "operation": operation, "value": value}])
        return [r.Id for r in events(spark, text, EventColumns(keys=["Id"], filters=filters)).collect()]

    assert sorted(kept("eq", 12)) == ["12", "12.0"]
    assert kept("eq", "12") == []
    assert kept("eq", "x12") == ["x12"]
    assert sorted(kept("ne", 12)) == ["13", "x12"]
    assert kept("contains", "12") == ["x12"]
    assert kept("regex", r"\d+$") == ["x12"]
    assert kept("gt", "12") == ["13"]
    assert kept("empty") == [None]
