"""Filters, aggregates, percentiles, formulas, sorting, time buckets, regex translation."""

from __future__ import annotations

import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.functions import regex
from logloom.functions.times import floor_time, nearest_time, parse_bucket
from logloom.operators.aggregates import Measure, aggregate, check_aggregate
from logloom.operators.filters import Filter, keep_rows, load_filters
from logloom.operators.formulas import add_formulas, formula_column
from logloom.operators.percentiles import exact_percentiles, value_range
from logloom.plans.report import sort_rows

# ---- filters -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [
        (1, "a", 12.0, 12, datetime(2024, 1, 1)), (2, " \u00a0", float("nan"), None, None), (3, None, None, 0, None),
        (4, "12", -1.5, 7, None), (5, "Abc\nx", 12.5, -3, None),
    ]
    return spark.createDataFrame(rows, "id int, s string, d double, n bigint, t timestamp_ntz").cache()


@pytest.mark.parametrize("key, operation, value, ids", [
    ("s", "eq", "12", [4]), ("s", "eq", 12, []), ("d", "eq", 12, [1]), ("d", "eq", "12", []), ("n", "eq", 7.0, [4]),
    ("n", "eq", True, []), ("t", "eq", "2024-01-01", []), ("s", "eq", None, []),
    ("s", "ne", "a", [2, 4, 5]), ("s", "ne", 12, [1, 2, 4, 5]), ("n", "ne", "7", [1, 3, 4, 5]), ("d", "ne", 12, [2, 4, 5]),
    ("d", "gt", "-2", [1, 4, 5]), ("s", "gt", 11, [4]), ("n", "ge", 0, [1, 3, 4]), ("n", "lt", 0, [5]), ("n", "le", 0, [3, 5]),
    ("d", "gt", "x", []), ("t", "gt", 0, []), ("n", "lt", None, []),
    ("s", "contains", "b", [5]), ("s", "contains", 1, []), ("n", "contains", "1", []),
    ("s", "regex", "^[A-Z]", [5]), ("s", "regex", r"^x$", []), ("s", "regex", r"(?m)^x\Z", [5]), ("n", "regex", ".", []),
    ("s", "filled", None, [1, 4, 5]), ("s", "empty", None, [2, 3]), ("d", "filled", None, [1, 2, 4, 5]), ("n", "empty", None, [2]),
    ("gone", "empty", None, [1, 2, 3, 4, 5]), ("gone", "filled", None, []), ("gone", "eq", 1, []), ("gone", "ne", 1, []),
])
def test_filter(mixed, key, operation, value, ids):
    kept = keep_rows(mixed, [Filter(key, operation, value)])
    assert sorted(r.id for r in kept.select("id").collect()) == ids


def test_filters_are_checked_when_loaded():
    for bad in ({"key": "a"}, {"key": "a", "operation": "like"}, {"key": "a", "operation": "regex", "value": "("},
                {"key": "a", "operation": "regex", "value": 5}, {"operation": "eq", "value": 1}):
        with pytest.raises(ValueError, match="filter 1"):
            load_filters([bad])
    assert load_filters(None) == []


def test_filter_reaches_the_scan(spark):
    df = keep_rows(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), [Filter("l_quantity", "ge", 10)])
    assert "GreaterThanOrEqual(l_quantity,10.0)" in df._jdf.queryExecution().executedPlan().toString()


PATTERNS = [
    (r"(?P<first_name>\w+) (?P=first_name)", ["ab ab", "ab ac", "ёж ёж"]), (r"a\Z", ["a", "a\n", "ba"]), (r"a$", ["a", "a\n", "a\r\n", "a\u2028"]),
    (r"[[a]b]?x", ["[x", "ax", "x", "b]x"]), (r"[a&&b]", ["&", "a", "c"]), (r"[]x]+y", ["]y", "xy", "y"]), (r"[^]x]y", ["ay", "]y"]),
    (r"^a{,2}$", ["", "aa", "aaa"]), (r"\bпривет\b", ["ну привет!", "приветы"]), (r"(?i)ПРИВЕТ", ["привет"]), (r"\d+", ["٣", "x"]),
    (r"(?a)^\w+$", ["ab", "ёж"]), (r"a.b", ["a\rb", "a\nb", "a\u2028b"]), (r"\v|\0", ["\x0b", "\x00", "\x0c", "v"]), (r"\.\[x\]\\", [".[x]\\", "a[x]\\"]),
]


def test_regex_means_the_same_in_java(spark):
    for pattern, texts in PATTERNS:
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = {r.t: r.m for r in df.select("t", F.col("t").rlike(regex.to_java(pattern)).alias("m")).collect()}
        assert got == {t: bool(re.search(pattern, t)) for t in texts}, pattern


def test_regex_without_counterpart():
    with pytest.raises(ValueError, match="conditional"):
        regex.to_java(r"(a)?(?(1)b|c)")


# ---- aggregates ----------------------------------------------------------------------------------


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    groups = {
        "one": np.array([3.5]), "documented": np.array([1.0, 2, 3, 10]), "same": np.full(50, 7.0),
        "signs": rng.normal(0, 1e-3, 999), "wide": np.exp(rng.normal(0, 12, 1001)) * rng.choice([-1, 1], 1001),
        "ties": rng.integers(-3, 4, 500).astype(float), "zero": np.array([-0.0, 0.0, 0.0]), None: rng.random(77) * 1e12,
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("documented", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r for r in exact_percentiles(df, ["k"], {"v": {"lo": 0.0, "m": 0.5, "p": 0.95, "hi": 1.0}}).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        for name, q in (("lo", 0), ("m", 50), ("p", 95), ("hi", 100)):
            assert got[key][name] == pytest.approx(np.percentile(values, q), rel=1e-12, abs=1e-300), (key, name)
    assert got["documented"].m == 2.5


def test_ranges_never_decrease(spark):
    values = sorted([0.0, -1e-320, 5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), *np.random.default_rng(1).normal(0, 1e3, 5000)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    ranges = [r[0] for r in df.orderBy("i").select(value_range(F.col("v"))).collect()]
    assert ranges == sorted(ranges)


def test_catalogue_on_one_group(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "v double").withColumn("k", F.lit("a"))
    names = ("sum", "min", "max", "mean", "median", "p95", "stddev", "percent")
    row = aggregate(df, ["k"], [Measure("v", names)]).first()
    assert (row.v, row.v_min, row.v_max, row.v_mean, row.v_median, row.v_percent) == (16, 1, 10, 4, 2.5, 100)
    assert row.v_p95 == pytest.approx(8.95) and row.v_stddev == pytest.approx(np.std([1, 2, 3, 10]))


def test_intervals_example(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (-1, 0, 4.9, 5, 25, 30)], "k int, v double")
    row = aggregate(df, ["k"], [Measure("v", ("intervals_5_5",))]).first().asDict()
    assert row == {
        "k": 1, "v_intervals_5_5_<5": 33.33, "v_intervals_5_5_5-10": 16.67, "v_intervals_5_5_10-15": 0.0,
        "v_intervals_5_5_15-20": 0.0, "v_intervals_5_5_20-25": 0.0, "v_intervals_5_5_25>": 33.33,
    }


def test_empty_and_null_groups(spark):
    df = spark.createDataFrame([(None, None), ("a", None), ("b", 2.0)], "k string, v double")
    rows = {r.k: r for r in aggregate(df, ["k"], [Measure("v", ("sum", "mean", "median", "percent"))]).collect()}
    assert {k: (r.v, r.v_mean, r.v_median, r.v_percent) for k, r in rows.items()} == {
        None: (0, None, None, 0), "a": (0, None, None, 0), "b": (2, 2, 2, 100),
    }


def test_unknown_aggregates_are_refused():
    for bad in ("total", "intervals_0_5", "intervals_5_0", "roundtime_0s", "roundtime_10000s", "roundtime_5w", "intervals_5"):
        with pytest.raises(ValueError):
            check_aggregate(bad)


def test_no_group_is_collected(spark):
    """No operator keeps a whole group's values in one row or one task's memory."""
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    made = aggregate(df, ["l_returnflag"], [Measure("l_extendedprice", ("median", "p95", "stddev", "percent"))])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "collect_list" not in plan and "Cartesian" not in plan


# ---- times, formulas, sorting --------------------------------------------------------------------


def test_time_buckets(spark):
    times = ["2024-01-01 12:04:00", "2024-01-01 12:09:00", "2024-01-01 12:06:00", "2024-01-01 12:02:30", "1969-12-31 23:59:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = df.select(floor_time(F.col("t"), "5m").cast("string").alias("f"), nearest_time(F.col("t"), "5m").cast("string").alias("n")).collect()
    assert [r.f[-8:-3] for r in got] == ["12:00", "12:05", "12:05", "12:00", "23:55"]
    assert [r.n[-8:-3] for r in got] == ["12:05", "12:10", "12:05", "12:05", "00:00"]
    week = spark.sql("SELECT timestamp_ntz'2025-10-13 12:00:00' t").select(floor_time(F.col("t"), "7d").cast("string")).first()[0]
    assert week == "2025-10-09 00:00:00"
    for bad in ("5", "0m", "m", "5w", ""):
        with pytest.raises(ValueError):
            parse_bucket(bad)


def test_time_buckets_know_no_time_zone(spark, conf):
    conf("spark.sql.session.timeZone", "America/New_York")
    df = spark.sql("SELECT timestamp_ntz'2024-07-04 00:30:00.25' a, timestamp_ntz'2024-03-10 02:30:00' b")
    cells = [floor_time(F.col("a"), "1d"), nearest_time(F.col("a"), "1h"), floor_time(F.col("b"), "5m"), floor_time(F.col("b"), "1d")]
    got = df.select(*[c.cast("string").alias(str(i)) for i, c in enumerate(cells)]).first()
    assert tuple(got) == ("2024-07-04 00:00:00", "2024-07-04 01:00:00", "2024-03-10 02:30:00", "2024-03-10 00:00:00")


def test_formulas(spark):
    df = spark.createDataFrame([(7, 2.0, 0), (-7, 2.0, 5), (7, -2.0, None)], "a int, b double, c int")
    cases = {
        "a / b": [3.5, -3.5, -3.5], "a // b": [3, -4, -4], "a % b": [1, 1, -1], "a / c": [None, -1.4, None],
        "a // c": [None, -2, None], "a % c": [None, 3, None], "-(a + 1) * 2": [-16, 12, -16], "a ** 2": [49, 49, 49],
        "2 + 3": [5, 5, 5], "a / 3": [2.333, -2.333, 2.333], "+a - b": [5, -9, 9],
    }
    got = df.select(*[formula_column(f).alias(str(i)) for i, f in enumerate(cases)]).collect()
    for i, (formula, expected) in enumerate(cases.items()):
        assert [r[i] for r in got] == expected, formula
    for bad in ("a +", "f(a)", "a.b", "a if b else c", "'x'", "a < b", "__import__('os')", "a and b", "True"):
        with pytest.raises(ValueError):
            formula_column(bad)
    with pytest.raises(ValueError, match="unknown column"):
        add_formulas(df, {"x": "a + z"})
    with pytest.raises(ValueError, match="unknown column"):
        add_formulas(df, {"x": "a + 1", "y": "x + 1"})


def test_sort_puts_null_first(spark):
    df = spark.createDataFrame([("10", 1), ("9", 2), (None, 3), ("9", 4)], "s string, n int")

    def order(*keys, by_number=()):
        return [r.n for r in sort_rows(df, keys, by_number).collect()]

    assert order(("s", False), ("n", True)) == [3, 1, 4, 2]
    assert order(("s", True), ("n", False)) == [3, 2, 4, 1]
    assert order(("s", False), ("n", False), by_number=("s",)) == [3, 2, 4, 1]


def test_percentiles_of_a_dominant_value_and_of_several_columns(spark):
    df = spark.range(20_000).selectExpr("1 AS k", "IF(id % 100 = 0, id, 0) AS a", "id AS b", "CAST(NULL AS BIGINT) AS c")
    made = aggregate(df, ["k"], [Measure("a", ("median", "p95")), Measure("b", ("p95",)), Measure("c", ("median",))])
    row = made.first()
    assert (row.a_median, row.a_p95, row.b_p95, row.c_median) == (0, 0, 18999.05, None)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") + plan.count("Scan") <= 4  # the groups, and one count of all columns, used twice


def test_nothing_overflows(spark):
    big = 2**62
    df = spark.createDataFrame([(1, big, big, "7"), (1, big, 3, "x"), (2, 5, 2, None)], "k int, a long, b long, t string")
    made = add_formulas(df, {"m": "a * b", "p": "a + a + a", "s": "-a - a - a", "q": "b / t", "r": "t + 1"}).orderBy("k", "b")
    rows = [(r.m, r.p, r.s, r.q, r.r) for r in made.collect()]
    assert rows == [(None, None, None, None, None), (None, None, None, round(big / 7, 3), 8), (10, 15, -15, None, None)]
    sums = {r.k: r.a for r in aggregate(df, ["k"], [Measure("a", ("sum",))]).collect()}
    assert sums == {1: None, 2: 5}


@pytest.mark.parametrize("operation, value, bound", [("ge", 3 * 2**30, 3 * 2**30), ("gt", 3.5, 3), ("ge", 3.5, 4), ("lt", 3.5, 4), ("le", "3.5", 3)])
def test_whole_bounds_reach_the_scan(spark, tmp_path, operation, value, bound):
    spark.range(6).withColumn("big", F.col("id") + 3 * 2**30 - 3).write.parquet(str(tmp_path / "t"))
    column = "big" if bound > 10 else "id"
    table = spark.read.parquet(str(tmp_path / "t"))
    kept = keep_rows(table, load_filters([{"key": column, "operation": operation, "value": value}]))
    sign = {"ge": "GreaterThanOrEqual", "gt": "GreaterThan", "lt": "LessThan", "le": "LessThanOrEqual"}[operation]
    assert f"{sign}({column},{bound})" in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 3 if column == "big" else kept.count() in (2, 4)
