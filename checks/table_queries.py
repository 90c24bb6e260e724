"""Filters, aggregates, sorting and text functions on tables as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded
from logloom.functions.text import last_line, normalize_sql
from logloom.functions.times import floor_time, nearest_time
from logloom.operators.aggregates import Measure, aggregate, interval_buckets
from logloom.operators.filters import keep_rows, load_filters
from logloom.operators.states import finished, merged, states_of
from logloom.plans.report import sort_rows


def kept(df, *filters):
    return keep_rows(df, load_filters([dict(zip(("key", "operation", "value"), f)) for f in filters]))


# ---- filters -------------------------------------------------------------------------------------

KIND = "CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN '  ' ELSE event_type END"
UID = "CASE WHEN event_type = 'view' THEN 'n/a' WHEN event_type = 'click' THEN NULL ELSE CAST(user_id AS VARCHAR) END"


def events_with_kind(table):
    return table("events").select("event_id", kind_of_event().alias("kind"))


def kind_of_event():
    return F.when(F.col("event_type") == "click", "  ").when(F.col("event_type") != "view", F.col("event_type"))


def events_with_uid(table):
    uid = F.when(F.col("event_type") == "view", "n/a").when(
        F.col("event_type") != "click", F.col("user_id").cast("string")
    )
    return table("events").select("event_id", uid.alias("uid"))


@query("flt_eq", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
    WHERE l_quantity = 25 AND l_returnflag = 'A'""")
def _(table):
    """Equality on a number and on a text."""
    df = table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return kept(df, ("l_quantity", "eq", 25), ("l_returnflag", "eq", "A"))


@query("flt_eq_type_mismatch", """
    SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3 AND 1 = 0""")
def _(table):
    """A number never equals a text."""
    return kept(table("lineitem").select("l_orderkey", "l_linenumber"), ("l_linenumber", "eq", "3"))


@query("flt_ne", f"SELECT event_id, {KIND} AS kind FROM events WHERE ({KIND}) IS NOT NULL AND ({KIND}) <> 'error'")
def _(table):
    """Inequality; NULL does not pass."""
    return kept(events_with_kind(table), ("kind", "ne", "error"))


@query("flt_gt", f"SELECT event_id, {UID} AS uid FROM events WHERE TRY_CAST({UID} AS DOUBLE) > 75")
def _(table):
    """Comparison of text by its number; text that is none does not pass."""
    return kept(events_with_uid(table), ("uid", "gt", 75))


@query("flt_ge", "SELECT event_id, value FROM events WHERE value >= 50.0")
def _(table):
    return kept(table("events").select("event_id", "value"), ("value", "ge", 50.0))


@query("flt_lt", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount < 0.05")
def _(table):
    return kept(table("lineitem").select("l_orderkey", "l_linenumber", "l_discount"), ("l_discount", "lt", 0.05))


@query("flt_le", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 100000")
def _(table):
    """The bound may be given as text."""
    return kept(table("orders").select("o_orderkey", "o_totalprice"), ("o_totalprice", "le", "100000"))


@query("flt_contains", "SELECT doc_id, text FROM documents WHERE contains(text, 'THE')")
def _(table):
    return kept(table("documents").select("doc_id", "text"), ("text", "contains", "THE"))


@query("flt_regex", r"""
    SELECT doc_id, text FROM documents WHERE regexp_matches(text, 'token = "?[0-9a-f]{8,}|(?:[0-9]{1,3}\.){3}[0-9]+')""")
def _(table):
    """Unanchored search with a pattern in Python syntax."""
    pattern = r'token = "?(?P<hex_digits>[0-9a-f]{8,})|(?:\d{1,3}\.){3}\d+'
    return kept(table("documents").select("doc_id", "text"), ("text", "regex", pattern))


@query("flt_filled", f"SELECT event_id, {KIND} AS kind FROM events WHERE trim(coalesce({KIND}, '')) <> ''")
def _(table):
    return kept(events_with_kind(table), ("kind", "filled"))


@query("flt_empty", f"SELECT event_id, {KIND} AS kind FROM events WHERE trim(coalesce({KIND}, '')) = ''")
def _(table):
    """NULL, blank text, and (second filter) a column that is not there."""
    return kept(events_with_kind(table), ("kind", "empty"), ("absent", "empty"))


@query("flt_all", """
    SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
    WHERE l_quantity >= 10 AND l_quantity < 40 AND l_returnflag <> 'R' AND l_linestatus = 'O' AND l_tax > 0.02""")
def _(table):
    df = table("lineitem")
    rows = kept(
        df, ("l_quantity", "ge", 10), ("l_quantity", "lt", "40"), ("l_returnflag", "ne", "R"),
        ("l_linestatus", "eq", "O"), ("l_tax", "gt", 0.02), ("l_shipdate", "filled"),
    )
    return rows.select("l_orderkey", "l_linenumber", "l_shipdate")


# ---- aggregates ----------------------------------------------------------------------------------

# event types with a NULL group, and values of both signs with NULLs among them
SHIFTED = f"SELECT {KIND} AS kind, user_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE value - 50 END AS v FROM events"


def shifted(table):
    v = F.when(F.col("user_id") % 7 != 0, F.col("value") - 50)
    return table("events").select(kind_of_event().alias("kind"), "user_id", v.alias("v"))


def shifted_by_kind(table, *aggregates, digits=6):
    made = aggregate(shifted(table), ["kind"], [Measure("v", aggregates)])
    return made.select(
        *[F.round(c, digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in made.dtypes]
    )


def shifted_sql(select):
    return f"SELECT kind, {select} FROM ({SHIFTED}) GROUP BY kind"


@query("agg_group_by", """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity FROM lineitem
    GROUP BY l_returnflag, l_linestatus""")
def _(table):
    return aggregate(table("lineitem"), ["l_returnflag", "l_linestatus"], [Measure("l_quantity", ("sum",))])


@query("agg_sum", f"""
    SELECT user_id, {rounded('coalesce(sum(v), 0)', 4)} AS v FROM ({SHIFTED}) GROUP BY user_id""")
def _(table):
    """A group without any value sums to 0."""
    made = aggregate(shifted(table), ["user_id"], [Measure("v", ("sum",))])
    return made.select("user_id", F.round("v", 4).alias("v"))


@query("agg_count", "SELECT event_type, CAST(count(*) AS BIGINT) AS count FROM events GROUP BY event_type")
def _(table):
    """Counting is summing the built-in column of ones."""
    ones = table("events").withColumn("count", F.lit(1).cast("bigint"))
    return aggregate(ones, ["event_type"], [Measure("count", ("sum",))])


@query("agg_min", shifted_sql("round(min(v), 6) AS v_min"))
def _(table):
    return shifted_by_kind(table, "min")


@query("agg_max", shifted_sql("round(max(v), 6) AS v_max"))
def _(table):
    return shifted_by_kind(table, "max")


@query("agg_mean", shifted_sql("round(avg(v), 6) AS v_mean"))
def _(table):
    return shifted_by_kind(table, "mean")


@query("agg_median", shifted_sql("round(median(v), 6) AS v_median"))
def _(table):
    return shifted_by_kind(table, "median")


@query("agg_p95", shifted_sql("round(quantile_cont(v, 0.95), 6) AS v_p95"))
def _(table):
    return shifted_by_kind(table, "p95")


@query("agg_p95_fine_groups", """
    SELECT l_suppkey, l_returnflag, round(median(l_extendedprice), 4) AS l_extendedprice_median,
           round(quantile_cont(l_extendedprice, 0.95), 4) AS l_extendedprice_p95
    FROM lineitem GROUP BY l_suppkey, l_returnflag""")
def _(table):
    """Both percentiles over many groups and many distinct values."""
    made = aggregate(
        table("lineitem"), ["l_suppkey", "l_returnflag"], [Measure("l_extendedprice", ("median", "p95"))]
    )
    return made.select(
        "l_suppkey", "l_returnflag",
        *[F.round(c, 4).alias(c) for c in ("l_extendedprice_median", "l_extendedprice_p95")],
    )


@query("agg_stddev", shifted_sql("round(stddev_pop(v), 6) AS v_stddev"))
def _(table):
    return shifted_by_kind(table, "stddev")


@query("agg_percent", f"""
    SELECT l_suppkey, {rounded('sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem) * 100')} AS l_quantity_percent
    FROM lineitem GROUP BY l_suppkey""")
def _(table):
    """Share of the total over all groups; the sum behind it is not shown."""
    return aggregate(table("lineitem"), ["l_suppkey"], [Measure("l_quantity", ("percent",))])


def _share(low, high):
    inside = f"v >= {low}" + (f" AND v < {high}" if high is not None else "")
    return rounded(f"count(*) FILTER (WHERE {inside}) / count(*) * 100")


@query("agg_intervals", shifted_sql(", ".join(
    f'{_share(low, high)} AS "v_intervals_20_3_{label}"'
    for label, low, high in [("<20", 0, 20), ("20-40", 20, 40), ("40-60", 40, 60), ("60>", 60, None)])))
def _(table):
    """Negative and missing values count in the total only."""
    return aggregate(shifted(table), ["kind"], [Measure("v", ("intervals_20_3",))])


def _wide(column, low, high):
    inside = f"{column} >= {low}" + (f" AND {column} < {high}" if high is not None else "")
    return rounded(f"count(*) FILTER (WHERE {inside}) / count(*) * 100")


WIDE = ("v", "user_id", "third")


@query("agg_intervals_wide", "SELECT kind, " + ", ".join(
    f'{_wide(c, low, high)} AS "{c}_intervals_1_500_{label}"' for c in WIDE for label, low, high in interval_buckets(1, 500)
) + f" FROM (SELECT *, v / 3 AS third FROM ({SHIFTED})) GROUP BY kind")
def _(table):
    """Three histograms of 500 buckets; negative and missing values count in the total only."""
    rows = shifted(table).withColumn("third", F.col("v") / 3)
    return aggregate(rows, ["kind"], [Measure(c, ("intervals_1_500",)) for c in WIDE])


@query("agg_states", shifted_sql(", ".join([
    "round(coalesce(sum(v), 0), 4) AS v", "round(min(v), 4) AS v_min", "round(max(v), 4) AS v_max", "round(avg(v), 6) AS v_mean", "round(median(v), 6) AS v_median",
    "round(quantile_cont(v, 0.95), 6) AS v_p95", "round(stddev_pop(v), 6) AS v_stddev",
    *[f'{_share(low, high)} AS "v_intervals_20_3_{label}"' for label, low, high in [("<20", 0, 20), ("20-40", 20, 40), ("40-60", 40, 60), ("60>", 60, None)]],
    "max(user_id) AS user_id_max", "CAST(sum(user_id) AS BIGINT) AS user_id",
    rounded(f"sum(user_id) / (SELECT sum(user_id) FROM ({SHIFTED})) * 100") + " AS user_id_percent",
])))
def _(table):
    """States of seven parts of a table, merged: the whole catalogue as for all rows at once."""
    measures = [Measure("v", ("sum", "min", "max", "mean", "median", "p95", "stddev", "intervals_20_3")), Measure("user_id", ("max", "sum", "percent"))]
    parts = states_of(shifted(table).withColumn("part", F.col("user_id") % 7), ["part", "kind"], measures)
    made = finished(merged(parts, ["kind"]), ["kind"], measures)
    digits = {"v": 4, "v_min": 4, "v_max": 4, "v_mean": 6, "v_median": 6, "v_p95": 6, "v_stddev": 6}
    return made.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _floor_sql(bucket):
    return f"time_bucket(INTERVAL '{bucket}', ts, TIMESTAMP '1970-01-01')"


@query("agg_roundtime_floor", " UNION ALL ".join(
    f"SELECT '{name}' AS bucket, {_floor_sql(sql)} AS ts, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 2"
    for name, sql in [("5m", "5 minutes"), ("90m", "90 minutes"), ("7d", "7 days")]))
def _(table):
    parts = [
        table("events").groupBy(F.lit(b).alias("bucket"), floor_time(F.col("ts"), b).alias("ts"))
        .agg(F.count(F.lit(1)).alias("n"))
        for b in ("5m", "90m", "7d")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("agg_roundtime_nearest", """
    SELECT time_bucket(INTERVAL '5 minutes', ts + INTERVAL '150 seconds', TIMESTAMP '1970-01-01') AS ts,
           CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def _(table):
    return table("events").groupBy(nearest_time(F.col("ts"), "5m").alias("ts")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_multi", f"""
    SELECT l_returnflag, l_linestatus,
           round(sum(l_quantity), 2) AS l_quantity, round(avg(l_quantity), 6) AS l_quantity_mean,
           min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max,
           round(median(l_extendedprice), 6) AS l_extendedprice_median,
           round(quantile_cont(l_discount, 0.95), 6) AS l_discount_p95,
           round(stddev_pop(l_tax), 6) AS l_tax_stddev,
           {rounded('sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem) * 100')} AS l_quantity_percent
    FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def _(table):
    """Several aggregates of several columns; a column named twice gets the union of its aggregates."""
    made = aggregate(table("lineitem"), ["l_returnflag", "l_linestatus"], [
        Measure("l_quantity", ("sum", "mean")), Measure("l_extendedprice", ("min", "max", "median")),
        Measure("l_discount", ("p95",)), Measure("l_tax", ("stddev",)), Measure("l_quantity", ("percent", "sum")),
    ])
    return made.select(
        *[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in made.dtypes]
    )


# ---- sort and limit ------------------------------------------------------------------------------


@query("srt_multi_key", f"""
    SELECT event_id, {KIND} AS kind FROM events""")
def _(table):
    """Several keys, NULL first in both directions; the register compares rows, a unit test the order."""
    return sort_rows(events_with_kind(table), (("kind", True), ("event_id", False)))


@query("srt_top_n", """
    SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25""")
def _(table):
    df = table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    order = (("l_extendedprice", True), ("l_orderkey", False), ("l_linenumber", False), ("l_partkey", False))
    return sort_rows(df, order).limit(25)


# ---- text functions ------------------------------------------------------------------------------

@query("txt_last_line", "SELECT doc_id, string_split(text, chr(10))[-1] AS last FROM documents")
def _(table):
    return table("documents").select("doc_id", last_line(F.col("text"), "\n").alias("last"))


@query("txt_normalize_sql", r"""
    SELECT doc_id, regexp_replace(text,
        '''\\[^'']*''::bytea|''\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}''::\w+|''[\p{L}\p{N}\p{M}_]*''|\b\d+\.\d+\b|\b\d+\b|VALUES\s*\([^)]+\)',
        '_PARAM_', 'g') AS shape FROM documents""")
def _(table):
    return table("documents").select("doc_id", normalize_sql(F.col("text")).alias("shape"))
