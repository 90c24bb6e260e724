"""Partial states that add up, the store kept up day by day, and histograms of many buckets."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators.aggregates import Measure, aggregate
from logloom.operators.histograms import bucket_of
from logloom.operators.states import finished, merged, states_of
from logloom.plans.report import run_report
from logloom.plans.spec import SpecError
from logloom.plans.store import ReportStore
from logloom.sources.watch import Watch

ALL = ("sum", "min", "max", "mean", "median", "p95", "stddev", "percent", "intervals_3_4", "intervals_9_30")


def numbers(spark, n=3000):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        group = rnd.choice(["a", "a", "a", "b", None, "empty"])
        v = None if group == "empty" or rnd.random() < 0.1 else rnd.choice([rnd.uniform(-20, 60), float(rnd.randint(0, 9)), 1e9 + rnd.random()])
        rows.append((group, rnd.randint(0, 9), v, rnd.randint(-5, 2**40), f"t{rnd.randint(0, 99)}"))
    return spark.createDataFrame(rows, "k string, part int, v double, w bigint, s string")


def comparable(rows, keys):
    made = {}
    for r in rows:
        d = r.asDict()
        made[tuple(d.pop(k) for k in keys)] = d
    return made


def same(a, b):
    return a == b or (a is not None and b is not None and not isinstance(a, str) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("cut", ["part", "1"])
def test_merged_states_are_the_state_of_all(spark, cut):
    df = numbers(spark).withColumn("cut", F.expr(cut))
    measures = [Measure("v", ALL), Measure("w", ALL), Measure("s", ("min", "max"))]
    want = comparable(aggregate(df, ["k"], measures).collect(), ["k"])
    states = states_of(df, ["cut", "k"], measures)
    once = comparable(finished(merged(states, ["k"]), ["k"], measures).collect(), ["k"])
    # merged in two steps, as a store that is itself merged
    halves = merged(states_of(df.where("part < 5"), ["cut", "k"], measures), ["k"]).and_those(merged(states_of(df.where("part >= 5"), ["cut", "k"], measures), ["k"]))
    twice = comparable(finished(merged(halves, ["k"]), ["k"], measures).collect(), ["k"])
    assert set(want) == set(once) == set(twice) == {("a",), ("b",), (None,), ("empty",)}
    for key, row in want.items():
        for made in (once, twice):
            assert set(made[key]) == set(row)
            assert [c for c in row if not same(row[c], made[key][c])] == []


def test_types_and_overflow(spark):
    df = spark.createDataFrame([("a", 0, 2**62), ("a", 1, 2**62), ("b", 0, 5)], "k string, part int, v bigint")
    measures = [Measure("v", ("sum", "mean", "max"))]
    made = finished(merged(states_of(df, ["part", "k"], measures), ["k"]), ["k"], measures)
    assert made.schema["v"].dataType == df.schema["v"].dataType and made.schema["v_max"].dataType == df.schema["v"].dataType
    assert {r["k"]: (r["v"], r["v_mean"]) for r in made.collect()} == {"a": (None, 2.0**62), "b": (5, 5.0)}
    with pytest.raises(ValueError, match="no number"):
        finished(states_of(numbers(spark, 10), ["k"], [Measure("s", ("sum",))]), ["k"], [Measure("s", ("sum",))])


def test_stable_moments(spark):
    """Values far from zero with little spread, in many parts."""
    df = spark.range(20000).select(F.lit("a").alias("k"), (F.col("id") % 200).alias("part"), (F.lit(1e9) + F.col("id") % 2).alias("v"))
    measures = [Measure("v", ("stddev",))]
    row = finished(merged(states_of(df, ["part", "k"], measures), ["k"]), ["k"], measures).first()
    assert row["v_stddev"] == pytest.approx(0.5, abs=1e-7)


# ---- histograms ----------------------------------------------------------------------------------


def test_buckets_keep_to_their_borders(spark):
    """The quotient of a number just below a border is the border's; the number is not in its bucket."""
    values = [float(b) * 3 for b in range(40)] + [math.nextafter(b * 3.0, -math.inf) for b in range(1, 40)] + [-0.0, -1e-300, -5.0, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    for r in df.select("v", bucket_of(F.col("v"), 3, 30).alias("b")).collect():
        v = r["v"]
        want = None if v is None or v < 0 else 30 if not v < 90 else next(i for i in range(30) if 3 * i <= v < 3 * (i + 1))
        assert r["b"] == want, v
    whole = spark.createDataFrame([(v,) for v in (-1, 0, 2, 3, 89, 90, 2**63 - 1)], "v bigint")
    assert [r["b"] for r in whole.select(bucket_of(F.col("v"), 3, 30).alias("b")).collect()] == [None, 0, 0, 1, 29, 30, 30]


def test_wide_histograms(spark):
    df = numbers(spark)
    want = comparable(aggregate(df, ["k"], [Measure("v", ("intervals_3_4",))]).collect(), ["k"])
    wide = comparable(aggregate(df, ["k"], [Measure("v", ("intervals_1_60", "intervals_3_4"))]).collect(), ["k"])
    for key, row in want.items():
        assert {c: wide[key][c] for c in row} == row
        assert sum(v for c, v in wide[key].items() if c.startswith("v_intervals_1_60")) == pytest.approx(sum(row.values()), abs=0.4)


def test_plan_does_not_grow_with_buckets(spark):
    df = numbers(spark, 10).withColumns({"x": F.col("v"), "y": F.col("v")})

    def plan(count):
        made = aggregate(df, ["k"], [Measure(c, (f"intervals_1_{count}",)) for c in ("v", "x", "y")])
        text = made._jdf.queryExecution().optimizedPlan().toString()
        return sum(len(line) for line in text.split("\n") if "Aggregate" in line or "Generate" in line)

    assert plan(500) < plan(100) + 1000


# ---- the store -----------------------------------------------------------------------------------

DEFINITION = {
    "logger_directory": "", "logger_file": "", "base_subdirectories": ["rphost_1"], "output_directory": "", "output_file": "",
    "start_period": "240101000000", "end_period": "240131235959", "event_name": "CALL", "event_limit": 0, "keys_aggregate": "Usr, timestamp", "keys_sort": "Usr, timestamp",
    "cpu_usage_percent": 50,
    "keys_result": [
        {"name": "Usr", "alias": "User"}, {"name": "timestamp", "alias": "Day", "aggregation": ["roundtime_1d"]}, {"name": "count", "aggregation": ["sum"]},
        {"name": "Memory", "aggregation": ["sum", "mean", "median", "stddev"]}, {"name": "each", "formula": "Memory / count"},
    ],
    "keys_filters": [{"key": "duration", "operation": "ge", "value": 0}],
}


def write_hour(folder, hour, n=30):
    rnd = random.Random(hour)
    lines = [f"{m:02d}:{rnd.randint(0, 59):02d}.1-{rnd.randint(1, 10**7)},CALL,1,Usr=u{rnd.randint(0, 3)},Memory={rnd.randint(0, 900)}" for m in range(n)]
    (folder / f"{hour}.log").write_text("\n".join(lines) + "\n")


@pytest.fixture
def tree(tmp_path):
    folder = tmp_path / "base" / "rphost_1"
    folder.mkdir(parents=True)
    for hour in ("24010110", "24010111", "24010205"):
        write_hour(folder, hour)
    return folder, {**DEFINITION, "base_directories": [str(tmp_path / "base")]}, str(tmp_path / "store")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_store_day_by_day(spark, tree):
    folder, definition, path = tree
    store = ReportStore(spark, definition, path)
    with pytest.raises(SpecError, match="nothing is stored"):
        store.report()
    assert store.update() == ["24010110", "24010111", "24010205"] and store.update() == []
    assert rows(store.report()) == rows(run_report(spark, definition)) != []
    write_hour(folder, "24010206")
    want = run_report(spark, definition)
    # what is stored is not read again: the old files are now noise of the same size
    for hour in ("24010110", "24010111", "24010205"):
        file = folder / f"{hour}.log"
        file.write_text("x" * file.stat().st_size)
    watch = Watch()
    assert store.update(watch) == ["24010206"] and watch.counts()["events"] == 30
    assert rows(store.report()) == rows(want)


def test_hours_that_grow_or_shrink(spark, tree):
    folder, definition, path = tree
    store = ReportStore(spark, definition, path)
    store.update()
    write_hour(folder, "24010111", 50)
    (folder / "24010205.log").write_text("no event at all, but a file of some length\n")
    assert store.update() == ["24010111", "24010205"]
    assert rows(store.report()) == rows(run_report(spark, definition))
    assert {r["__hour"] for r in store.hours().collect()} == {"24010110", "24010111", "24010205"}


def test_periods_that_cut_hours(spark, tree):
    from datetime import datetime

    folder, definition, path = tree
    store = ReportStore(spark, definition, path)
    store.update()
    for start, end in (("240101100500", "240102051000"), ("240101100500", "240101102000"), ("240101110000", "240102045959")):
        cut = {**definition, "start_period": start, "end_period": end}
        at = [datetime.strptime(t, "%y%m%d%H%M%S") for t in (start, end)]
        assert rows(store.report(*at)) == rows(run_report(spark, cut))


def test_an_update_that_fails_is_not_seen(spark, tree, monkeypatch):
    folder, definition, path = tree
    store = ReportStore(spark, definition, path)
    store.update()
    before = rows(store.report())
    write_hour(folder, "24010207")

    def fails(*args, **more):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(spark, "createDataFrame", fails)
        with pytest.raises(OSError):
            store.add(store.spark.range(0).selectExpr("'' AS file_path", "0L AS block", "0L AS pos", "true AS sole", "'' AS value"), [("24010207", 1, 1)])
    assert rows(store.report()) == before
    assert store.update() == ["24010207"]
    assert rows(store.report()) == rows(run_report(spark, definition))


def test_another_report_has_another_store(spark, tree):
    folder, definition, path = tree
    ReportStore(spark, definition, path).update()
    other = {**definition, "keys_filters": []}
    with pytest.raises(SpecError, match="another report"):
        ReportStore(spark, other, path).report()
    with pytest.raises(SpecError, match="another report"):
        ReportStore(spark, other, path).update()
    shown = {**definition, "event_limit": 2, "keys_sort": "Usr desc", "keys_result": [{**definition["keys_result"][0], "alias": "Who"}, *definition["keys_result"][1:]]}
    assert rows(ReportStore(spark, shown, path).report()) == rows(run_report(spark, shown))
    with pytest.raises(SpecError, match="grouped"):
        ReportStore(spark, {**definition, "keys_aggregate": ""}, path)


# ---- percentiles with a bound --------------------------------------------------------------------


def test_order_keys(spark):
    import struct

    from logloom.operators.percentiles import order_key

    rnd = random.Random(1)
    values = [struct.unpack("<d", rnd.randbytes(8))[0] for _ in range(3000)]
    values += [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, float("inf"), -float("inf"), float("nan"), 1.7976931348623157e308]
    values += [x for e in range(-1000, 1024) for x in (2.0**e, 2.0**e * (1 - 2**-53))]
    for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", order_key(F.col("v")).alias("k")).collect():
        bits = struct.unpack("<Q", struct.pack("<d", abs(r["v"])))[0]
        assert r["k"] == (2047 * 2**52 + 1 if math.isnan(r["v"]) else -bits if r["v"] < 0 else bits)


def test_digits_give_the_same_percentiles(spark, tmp_path):
    from logloom.operators.percentiles import exact_percentiles, select_by_digits, value_counts
    from logloom.plans.report import keeper

    df = numbers(spark).withColumn("v", F.when(F.col("k") == "b", F.lit(1000.0) + F.col("w") % 997 * 1e-9).otherwise(F.col("v")))
    wanted = {"v": {"m": 0.5, "p": 0.95, "low": 0.0, "high": 1.0}, "w": {"wm": 0.5}}
    want = comparable(exact_percentiles(df, ["k"], wanted).collect(), ["k"])
    for most in (1, 50, 1 << 16):
        made = select_by_digits(value_counts(df, ["k"], list(wanted)), ["k"], wanted, keeper(spark, str(tmp_path / str(most))), most)
        assert comparable(made.collect(), ["k"]) == want


def test_crowded_range_is_not_ordered_by_one_task(spark, tmp_path):
    """A million different values within a millionth of each other: ranges with more than the bound are opened digit by digit."""
    from logloom.operators.percentiles import MOST_ORDERED, select_by_digits, value_counts
    from logloom.plans.report import keeper

    n, tables = 1_000_000, []
    df = spark.range(n).select(F.lit("a").alias("k"), (F.lit(1000.0) + F.col("id") * 1e-9).alias("v"))
    store = keeper(spark, str(tmp_path))

    def keep(table):
        tables.append(store(table))
        return tables[-1]

    counts = value_counts(df, ["k"], ["v"])
    row = select_by_digits(counts, ["k"], {"v": {"m": 0.5, "p": 0.95}}, keep).first()
    values = [1000.0 + i * 1e-9 for i in range(n)]
    assert (row["m"], row["p"]) == ((values[499999] + values[500000]) / 2, pytest.approx(values[949999] * 0.95 + values[950000] * 0.05, rel=1e-15))
    first, *rest = tables[1:]
    assert first.agg(F.max("__d")).first()[0] > MOST_ORDERED >= rest[-1].agg(F.max("__d")).first()[0]
