"""Whole reports, over tables and over the rendered log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks.log_queries import EV, log_lines
from checks.registry import query, rounded
from logloom.plans import presets
from logloom.plans.report import report, report_lines, reports_together
from logloom.plans.store import ReportStore
from logloom.sinks import read_table, write_table
from logloom.sources.events import scratch_folder

# ---- layout --------------------------------------------------------------------------------------


def log_report(table, spec, staged=True):
    """Reports with several branches read the log once; listings and single groupings stay one lazy plan."""
    lines = log_lines(table)
    return report_lines(lines, spec, stage=scratch_folder(lines.sparkSession) if staged else None)


def lineitem_spec(**more):
    return {
        "keys_result": [
            {"name": "l_linestatus", "alias": "Status"},
            {"name": "l_quantity", "alias": "Quantity", "aggregation": ["max", "sum", "intervals_20_2", "mean"]},
            {"name": "l_returnflag", "alias": "Flag"},
        ],
        "keys_aggregate": "l_returnflag, l_linestatus",
        **more,
    }


def _share(inside):
    return rounded(f"count(*) FILTER (WHERE {inside}) / count(*) * 100")


@query("rep_column_order", f"""
    SELECT l_linestatus AS "Status", max(l_quantity) AS "Quantity (max)", round(sum(l_quantity), 2) AS "Quantity (sum)",
           {_share('l_quantity >= 0 AND l_quantity < 20')} AS "Quantity (<20)",
           {_share('l_quantity >= 20 AND l_quantity < 40')} AS "Quantity (20-40)",
           {_share('l_quantity >= 40')} AS "Quantity (40>)", {rounded('avg(l_quantity)')} AS "Quantity (avg)",
           l_returnflag AS "Flag"
    FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def _(table):
    return report(table("lineitem"), lineitem_spec())


@query("rep_aliases", f"""
    SELECT l_returnflag AS "l_returnflag", min(l_tax) AS "Налог (min)", max(l_tax) AS "Налог (max)",
           {rounded('avg(l_tax)')} AS "Налог (avg)", {rounded('median(l_tax)')} AS "Налог (mdn)",
           {rounded('quantile_cont(l_tax, 0.95)')} AS "Налог (P95)", {rounded('stddev_pop(l_tax)')} AS "Налог (stddev)",
           {rounded('sum(l_tax)')} AS "Налог (sum)",
           {rounded('sum(l_tax) / (SELECT sum(l_tax) FROM lineitem) * 100')} AS "Налог (% влияния)"
    FROM lineitem GROUP BY l_returnflag""")
def _(table):
    """Every header suffix; a key without an alias keeps its name."""
    spread = ["min", "max", "mean", "median", "p95", "stddev", "sum", "percent"]
    keys = [{"name": "l_returnflag"}, {"name": "l_tax", "alias": "Налог", "aggregation": spread}]
    return report(table("lineitem"), {"keys_result": keys, "keys_aggregate": "l_returnflag"})


@query("rep_formula", """
    SELECT o_orderkey, round(o_totalprice / 7, 3) AS a, round(-(o_totalprice - 1000) * 2.5 + o_custkey, 3) AS b,
           CAST(floor(o_custkey / 7.0) AS BIGINT) AS c, o_custkey % 7 AS d,
           round(o_totalprice / nullif(o_custkey, 0), 3) AS e, pow(o_custkey, 2) AS f
    FROM orders""")
def _(table):
    """All operators; formulas see columns, not each other; division by zero gives NULL."""
    formulas = {
        "a": "o_totalprice / 7", "b": "-(o_totalprice - 1000) * 2.5 + o_custkey", "c": "o_custkey // 7",
        "d": "o_custkey % 7", "e": "o_totalprice / o_custkey", "f": "o_custkey ** 2",
    }
    keys = [{"name": "o_orderkey"}, *[{"name": n, "formula": f} for n, f in formulas.items()]]
    return report(table("orders"), {"keys_result": keys})


@query("rep_rounding", f"""
    SELECT l_tax, {rounded('avg(l_discount)')} AS "l_discount (avg)", CAST(count(*) AS BIGINT) AS "count (sum)",
           {rounded('round(sum(l_discount) / count(*), 3)')} AS each
    FROM lineitem GROUP BY l_tax""")
def _(table):
    """Two digits in grouped reports, but not for the keys; formulas are rounded to three first."""
    from pyspark.sql import functions as F

    keys = [
        {"name": "l_tax"}, {"name": "l_discount", "aggregation": ["mean"]}, {"name": "count", "aggregation": ["sum"]},
        {"name": "each", "formula": "l_discount_mean"},
    ]
    ones = table("lineitem").withColumn("count", F.lit(1).cast("bigint"))
    return report(ones, {"keys_result": keys, "keys_aggregate": "l_tax"})


# ---- reports over the log ------------------------------------------------------------------------

SPREAD = f"""
    {rounded('sum(duration)')} AS "Duration, s (sum)",
    {rounded('sum(duration) / (SELECT sum(duration) FROM ev) * 100')} AS "Duration, s (% влияния)",
    {rounded('avg(duration)')} AS "Duration, s (avg)", {rounded('median(duration)')} AS "Duration, s (mdn)",
    {rounded('quantile_cont(duration, 0.95)')} AS "Duration, s (P95)",
    {rounded('stddev_pop(duration)')} AS "Duration, s (stddev)",
    min(duration) AS "Duration, s (min)", max(duration) AS "Duration, s (max)",
    {_share('duration < 3')} AS "Duration, s (<3)",
    {_share('duration >= 3 AND duration < 6')} AS "Duration, s (3-6)",
    {_share('duration >= 6 AND duration < 9')} AS "Duration, s (6-9)",
    {_share('duration >= 9 AND duration < 12')} AS "Duration, s (9-12)",
    {_share('duration >= 12 AND duration < 15')} AS "Duration, s (12-15)",
    {_share('duration >= 15')} AS "Duration, s (15>)"
"""


def ev(event, more=""):
    return f"WITH ev AS (SELECT * FROM ({EV}) WHERE \"Name\" = '{event}' {more})"


PERIOD = {"start_period": "240103120000", "end_period": "240125235959"}
IN_PERIOD = "AND \"timestamp\" BETWEEN TIMESTAMP '2024-01-03 12:00:00' AND TIMESTAMP '2024-01-25 23:59:59'"


@query("report_grouped", f"""
    {ev('CLICK', IN_PERIOD + ' AND "Memory" > 800 AND "Usr" <> ' + "'U8' AND regexp_matches(\"Context\", 'last [1-4]')")}
    SELECT "p:processName" AS "База", CAST(count(*) AS BIGINT) AS "N (sum)",
           CAST(sum("Memory") AS DOUBLE) AS "Memory (sum)", {SPREAD},
           {rounded('round(round(sum(duration), 9) / count(*), 3)')} AS "Each"
    FROM ev GROUP BY "p:processName" """)
def _(table):
    """Filters, grouping, the whole catalogue and a formula, from a log read once."""
    spread = ["sum", "percent", "mean", "median", "p95", "stddev", "min", "max", "intervals_3_5"]
    spec = {
        **PERIOD, "event_name": "CLICK", "event_limit": 0,
        "keys_result": [
            {"name": "p:processName", "alias": "База"},
            {"name": "count", "alias": "N", "aggregation": ["sum"]},
            {"name": "Memory", "aggregation": ["sum"]},
            {"name": "duration", "alias": "Duration, s", "aggregation": spread},
            {"name": "Each", "formula": "duration / count"},
        ],
        "keys_filters": [
            {"key": "Memory", "operation": "gt", "value": 800},
            {"key": "Usr", "operation": "ne", "value": "U8"},
            {"key": "Context", "operation": "regex", "value": "last [1-4]$"},
        ],
        "keys_aggregate": "p:processName", "keys_sort": "duration desc",
    }
    return log_report(table, spec)


STORED = {
    "event_name": "CLICK", "event_limit": 0, "keys_aggregate": "p:processName", "keys_sort": "duration desc",
    "keys_result": [
        {"name": "p:processName", "alias": "База"}, {"name": "count", "alias": "N", "aggregation": ["sum"]}, {"name": "Memory", "aggregation": ["sum"]},
        {"name": "duration", "alias": "Duration, s", "aggregation": ["sum", "percent", "mean", "median", "p95", "stddev", "min", "max", "intervals_3_5"]},
        {"name": "Each", "formula": "duration / count"},
    ],
}


@query("report_stored", f"""
    {ev('CLICK', IN_PERIOD + ' AND "Memory" IS NOT NULL')}
    SELECT "p:processName" AS "База", CAST(count(*) AS BIGINT) AS "N (sum)",
           CAST(sum("Memory") AS DOUBLE) AS "Memory (sum)", {SPREAD},
           {rounded('round(round(sum(duration), 9) / count(*), 3)')} AS "Each"
    FROM ev GROUP BY "p:processName" """)
def _(table):
    """A report over some weeks from states that were stored day by day, the hours of one day twice."""
    lines = log_lines(table)
    spark = lines.sparkSession
    store = ReportStore(spark, STORED, scratch_folder(spark), from_files=False)
    hour = F.regexp_extract("file_path", "([0-9]{8})[.]log$", 1)
    sized = lines.groupBy(hour.alias("hour")).agg(F.count_distinct("file_path").alias("files"), F.sum(F.octet_length("value")).alias("bytes"))
    hours = [tuple(r) for r in sized.orderBy("hour").collect()]
    days = sorted({h[0][:6] for h in hours})
    for some in (days[: len(days) // 2], days[len(days) // 2 :], days[5:6]):
        store.add(lines.where(F.substring(hour, 1, 6).isin(some)), [h for h in hours if h[0][:6] in some])
    return store.report(datetime(2024, 1, 3, 12), datetime(2024, 1, 25, 23, 59, 59))


@query("report_events", f"""
    {ev('ERROR', IN_PERIOD)}
    SELECT "timestamp" AS "Дата", processname AS "Процесс", "Usr", CAST(event_id AS VARCHAR) AS "EventId",
           duration AS "Длительность (sum)", "Context" FROM ev
    ORDER BY duration DESC, event_id LIMIT 200""")
def _(table):
    """A listing of single events: no grouping, no rounding, the longest first."""
    spec = {
        **PERIOD, "event_name": "ERROR", "event_limit": 200,
        "keys_result": [
            {"name": "timestamp", "alias": "Дата"}, {"name": "processname", "alias": "Процесс"}, {"name": "Usr"},
            {"name": "EventId"}, {"name": "duration", "alias": "Длительность", "aggregation": ["sum", "mean"]},
            {"name": "Context"},
        ],
        "keys_filters": [], "keys_aggregate": "", "keys_sort": "duration desc, EventId asc",
    }
    return log_report(table, spec, staged=False)


TOP_CALLS_SQL = f"""
    {ev('CLICK')} SELECT "Context", {SPREAD}, CAST(count(*) AS BIGINT) AS "Count (sum)" FROM ev GROUP BY "Context"
    ORDER BY sum(duration) DESC, "Context" LIMIT 50"""


@query("report_late_texts", f"""
    {ev('ERROR', IN_PERIOD)}
    SELECT "timestamp" AS "Дата", "Usr", CAST(event_id AS VARCHAR) AS "EventId", duration AS "Длительность", round(duration / 2, 3) AS "half", "Sql", "Context" FROM ev
    ORDER BY round(duration / 2, 3) DESC, event_id LIMIT 100""")
def _(table):
    """A listing of wide rows by a formula: the rows are found by their sort keys, their texts are read afterwards."""
    spec = {
        **PERIOD, "event_name": "ERROR", "event_limit": 100, "keys_aggregate": "", "keys_sort": "half desc, EventId asc",
        "keys_result": [
            {"name": "timestamp", "alias": "Дата"}, {"name": "Usr"}, {"name": "EventId"}, {"name": "duration", "alias": "Длительность"},
            {"name": "half", "formula": "duration / 2"}, {"name": "Sql"}, {"name": "Context"},
        ],
    }
    return log_report(table, spec)


@query("preset_top_calls", TOP_CALLS_SQL)
def _(table):
    return log_report(table, presets.over(presets.top_calls(), event_name="CLICK"))


@query("preset_duration_by_context", f"""
    {ev('VIEW')} SELECT lastcontext AS "Context line", {rounded('sum(duration)')} AS "Duration, s (sum)",
        {rounded('sum(duration) / (SELECT sum(duration) FROM ev) * 100')} AS "Duration, s (% влияния)",
        CAST(count(*) AS BIGINT) AS "Count (sum)",
        {rounded('round(round(sum(duration), 9) / count(*), 3)')} AS "Per call, s"
    FROM ev GROUP BY lastcontext""")
def _(table):
    return log_report(table, presets.duration_by_context("VIEW"))


@query("preset_memory_by_user", f"""
    {ev('PURCHASE', 'AND "Memory" IS NOT NULL')}
    SELECT "Usr" AS "User", CAST(sum("Memory") AS DOUBLE) AS "Memory, bytes (sum)",
        CAST(max("Memory") AS DOUBLE) AS "Memory, bytes (max)", {rounded('avg("Memory")')} AS "Memory, bytes (avg)",
        CAST(count(*) AS BIGINT) AS "Count (sum)"
    FROM ev GROUP BY "Usr" ORDER BY sum("Memory") DESC, "Usr" LIMIT 20""")
def _(table):
    return log_report(table, presets.over(presets.memory_by_user(), event_name="PURCHASE"), staged=False)


SLOW_SQL_SQL = f"""
    {ev('ERROR')} SELECT "Sql" AS "Query", {rounded('sum(duration)')} AS "Duration, s (sum)",
        max(duration) AS "Duration, s (max)", {rounded('quantile_cont(duration, 0.95)')} AS "Duration, s (P95)",
        {rounded('sum(duration) / (SELECT sum(duration) FROM ev) * 100')} AS "Duration, s (% влияния)",
        CAST(count(*) AS BIGINT) AS "Count (sum)"
    FROM ev GROUP BY "Sql" """


@query("preset_slow_sql", SLOW_SQL_SQL)
def _(table):
    return log_report(table, presets.slow_sql("ERROR"))


LOCKS_SQL = f"""
    {ev('SIGNUP')} SELECT "timestamp" AS "Time", processname AS "Process", filename AS "File", "Usr" AS "User",
        "Context", duration AS "Duration, s" FROM ev"""


@query("preset_locks", LOCKS_SQL)
def _(table):
    return log_report(table, presets.locks("SIGNUP"), staged=False)


@query("preset_time_series", f"""
    {ev('VIEW')} SELECT time_bucket(INTERVAL '5 minutes', "timestamp", TIMESTAMP '1970-01-01') AS "Time (round 5m)",
        CAST(count(*) AS BIGINT) AS "Count (sum)", {rounded('avg(duration)')} AS "Duration, s (avg)"
    FROM ev GROUP BY 1""")
def _(table):
    return log_report(table, presets.time_series("VIEW"), staged=False)


# ---- sinks ---------------------------------------------------------------------------------------


@query("snk_round_trip", " UNION ALL ".join(
    f"""SELECT '{fmt}' AS format, doc_id, text, '  "' || coalesce(lang, '') || '", ' || chr(10) || ' x ' AS marked FROM documents""" for fmt in ("csv", "json", "parquet")))
def _(table):
    """Texts with line breaks, quotes, commas and outer spaces, written in each format over an earlier table and read back."""
    docs = table("documents").select("doc_id", "text", F.concat(F.lit('  "'), F.coalesce("lang", F.lit("")), F.lit('", \n x ')).alias("marked"))
    spark, back = docs.sparkSession, None
    for fmt in ("csv", "json", "parquet"):
        path = write_table(docs.limit(1), scratch_folder(spark) + f".{fmt}", fmt)
        made = read_table(spark, write_table(docs, path, fmt), fmt, docs.schema).select(F.lit(fmt).alias("format"), *docs.columns)
        back = made if back is None else back.unionByName(made)
    return back


# ---- several reports from one reading ------------------------------------------------------------


def all_presets():
    return {
        "top_calls": presets.over(presets.top_calls(), event_name="CLICK"), "duration_by_context": presets.duration_by_context("VIEW"),
        "memory_by_user": presets.over(presets.memory_by_user(), event_name="PURCHASE"), "slow_sql": presets.slow_sql("ERROR"),
        "locks": presets.locks("SIGNUP"), "time_series": presets.time_series("VIEW"),
    }


def together(table, name):
    """One of six reports that are made from one reading of the log."""
    lines, specs = log_lines(table), all_presets()
    made = reports_together(lines, list(specs.values()), scratch_folder(lines.sparkSession))
    return dict(zip(specs, made))[name]


@query("together_top_calls", TOP_CALLS_SQL)
def _(table):
    return together(table, "top_calls")


@query("together_slow_sql", SLOW_SQL_SQL)
def _(table):
    return together(table, "slow_sql")


@query("together_locks", LOCKS_SQL)
def _(table):
    return together(table, "locks")
