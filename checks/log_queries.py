"""The log source, over the events table written out as log lines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks.registry import query
from logloom.functions import mixed
from logloom.operators.filters import Filter, all_of
from logloom.plans.report import report_lines
from logloom.rendered import render, rendered_files
from logloom.sources.events import EventColumns, log_events, scratch_folder
from logloom.sources.files import file_inventory, select_log_files, skipped_files
from logloom.sources.framing import frame_events
from logloom.sources.lines import decode_lines, read_lines
from logloom.sources.watch import Watch

FIRST = """strftime(ts, '%M:%S.%f') || '-' || CAST(round(value * 1000000) AS BIGINT) || ',' || upper(event_type)
    || ',1,process=rphost,p:processName=base' || (user_id % 5) || ',Usr=U' || user_id || ',EventId=' || event_id
    || CASE WHEN event_id % 3 <> 0 THEN ',Memory=' || (event_id * 8) ELSE '' END
    || CASE WHEN event_id % 4 = 0 THEN ',Note="said ""hi"" ,Inner=nobody ' || (event_id % 5) || ', ok"' ELSE '' END
    || ',Sql="SELECT c' || (event_id % 3) || ' FROM pg_temp.tt' || event_id || ' WHERE b = ''x' || user_id
    || ''' AND c = ' || event_id || ' AND d > 1.5"' || ',Context=''step ' || (event_id % 7)"""
SECOND = "'   last ' || (event_id % 5) || '''  '"

# the events table with everything that can be read from its log
EV = """SELECT event_id, user_id, ts, date_trunc('second', ts) AS "timestamp", upper(event_type) AS "Name",
    CAST(1 AS BIGINT) AS "count", round(value * 1000000) / 1000000 AS duration,
    strftime(ts, '%y%m%d%H') || '.log' AS filename, 'rphost_' || (user_id % 4) AS processname,
    'U' || user_id AS "Usr", 'base' || (user_id % 5) AS "p:processName",
    CASE WHEN event_id % 3 <> 0 THEN event_id * 8 END AS "Memory",
    CASE WHEN event_id % 4 = 0 THEN 'said ""hi"" ,Inner=nobody ' || (event_id % 5) || ', ok' END AS "Note",
    CASE WHEN event_id % 4 = 0 THEN 'nobody ' || (event_id % 5) END AS "Inner",
    'SELECT c' || (event_id % 3) || ' FROM pg_temp_table WHERE b = _PARAM_ AND c = _PARAM_ AND d > _PARAM_' AS "Sql",
    'step ' || (event_id % 7) || chr(10) || 'last ' || (event_id % 5) AS "Context",
    'last ' || (event_id % 5) AS lastcontext
    FROM events"""

FILES = f"""SELECT '/logs/full/rphost_' || (user_id % 4) || '/' || strftime(ts, '%y%m%d%H') || '.log' AS path,
    CAST(sum(octet_length(CAST({FIRST} AS BLOB)) + 2 + octet_length(CAST({SECOND} AS BLOB)) + 2) AS BIGINT) AS length
    FROM events GROUP BY 1"""


def log_lines(table, root="/logs/full"):
    return render(table("events"), root)


def event_rows(table, event_name, keys, require_all=False, types=None, start=None, end=None):
    columns = EventColumns(keys=keys, require_all=require_all, types=types or {})
    return log_events(log_lines(table), columns, event_name, start, end).select(*[f"`{k}`" for k in keys])


# ---- files and lines -----------------------------------------------------------------------------


@query("src_list_files", f"SELECT path, length FROM ({FILES}) WHERE contains(path, '/rphost_1/') OR contains(path, '/rphost_2/')")
def _(table):
    """Files in directories of a listed name; a base whose own name is listed would take all of its files."""
    files = rendered_files(log_lines(table))
    return select_log_files(files, ["/logs/full"], ["rphost_1", "rphost_2", "logs"], prune=False)


@query("src_prune_files", f"""
    SELECT path, length FROM ({FILES})
    WHERE right(path, 12) BETWEEN '24010512.log' AND '24012018.log' AND length > 300""")
def _(table):
    """By the hour in the name and by size; a period that starts inside an hour keeps that hour's file."""
    files = rendered_files(log_lines(table))
    start, end = datetime(2024, 1, 5, 12, 30), datetime(2024, 1, 20, 18, 59, 59)
    return select_log_files(files, ["/logs"], ["full"], start, end, min_size=300)


@query("src_inventory", f"""
    SELECT CAST(count(*) AS BIGINT) AS files, round(sum(length) / 1048576.0, 6) AS total_mb FROM ({FILES})""")
def _(table):
    chosen = select_log_files(rendered_files(log_lines(table)), ["/logs/full"], ["full"])
    return file_inventory(chosen).select("files", F.round("total_mb", 6).alias("total_mb"))


@query("src_read_lines", f"SELECT {FIRST} AS value FROM events UNION ALL SELECT {SECOND} AS value FROM events")
def _(table):
    """The log written as text files and read back in splits."""
    lines = log_lines(table)
    folder = scratch_folder(lines.sparkSession)
    lines.select("value").write.text(folder)
    return read_lines(lines.sparkSession, [folder], glob="part-*").select("value")


@query("src_decode", """
    SELECT event_id, 'Пользователь № ' || user_id || ' «' || event_type || '» – ёлка' AS value FROM events""")
def _(table):
    """Lines in UTF-8 and in windows-1251 within one table."""
    # The characters of the sample text that windows-1251 has as single bytes, as latin-1
    wide = "ПользвателькёаN№«»–"
    narrow = wide.encode("cp1251").decode("latin-1")
    value = F.concat(
        F.lit("Пользователь № "), F.col("user_id"), F.lit(" «"), F.col("event_type"), F.lit("» – ёлка")
    )
    cp1251 = F.encode(F.translate(value, wide, narrow), "ISO-8859-1").cast("string")
    mixed = F.when(F.col("user_id") % 2 == 0, cp1251).otherwise(value)
    return decode_lines(table("events").select("event_id", mixed.alias("value")))


# every 7th event has a minute that is none, every 11th file starts with lines of no event, every 5th file has no hour in its name
def damaged_lines(table):
    lines = log_lines(table)
    first = F.col("value").rlike("^[0-9][0-9]:") & F.col("value").contains(",EventId=")
    event = F.regexp_extract("value", ",EventId=([0-9]+)", 1).try_cast("bigint")
    value = F.when(first & (event % 7 == 0), F.concat(F.lit("75"), F.substr("value", F.lit(3)))).otherwise(F.col("value"))
    hour = F.regexp_extract("file_path", "([0-9]{2})[.]log$", 1).cast("int")
    heads = lines.select("file_path").distinct().where(hour % 11 == 0)
    heads = heads.select("file_path", F.lit(-2).cast("bigint").alias("block"), F.explode(F.sequence(F.lit(-2).cast("bigint"), F.lit(-1).cast("bigint"))).alias("pos"), F.lit(False).alias("sole"), F.lit("no event").alias("value"))
    return lines.withColumn("value", value).unionByName(heads)


@query("src_skipped", f"""
    WITH wanted AS (SELECT * FROM ({EV}) WHERE "Name" = 'CLICK'), timed AS (SELECT * FROM wanted WHERE event_id % 7 <> 0), whole AS (SELECT * FROM timed WHERE "Memory" IS NOT NULL)
    SELECT 'untimed' AS reason, CAST(count(*) AS BIGINT) AS n FROM wanted WHERE event_id % 7 = 0
    UNION ALL SELECT 'lost_lines', CAST(2 * count(DISTINCT processname || filename) AS BIGINT) FROM ({EV}) WHERE CAST(filename[7:8] AS INT) % 11 = 0
    UNION ALL SELECT 'malformed', 0
    UNION ALL SELECT 'incomplete', CAST(count(*) AS BIGINT) FROM timed WHERE "Memory" IS NULL
    UNION ALL SELECT 'filtered', CAST(count(*) AS BIGINT) FROM whole WHERE NOT duration > 100
    UNION ALL SELECT 'events', CAST(count(*) AS BIGINT) FROM whole WHERE duration > 100""")
def _(table):
    """How many lines and events are left out, and why, counted by the one reading of the log."""
    lines, watch = damaged_lines(table), Watch()
    spark = lines.sparkSession
    columns = EventColumns(keys=["Usr", "Memory"], filters=[Filter("duration", "gt", 100)])
    log_events(lines, columns, "CLICK", stage=scratch_folder(spark), watch=watch)
    return spark.createDataFrame(list(watch.counts().items()), "reason string, n long")


@query("src_skipped_files", f"""
    WITH f AS (SELECT CASE WHEN CAST(path[-6:-5] AS INT) % 5 = 0 THEN replace(path, '.log', '') || 'x' || path[-12:-5] || '.log' ELSE path END AS path, length,
        path[-12:-5] AS hour, CAST(path[-6:-5] AS INT) % 5 = 0 AS bad FROM ({FILES}))
    SELECT replace(path, hour || 'x', 'x') AS path, length, CASE WHEN bad THEN 'name' WHEN NOT hour BETWEEN '24010512' AND '24012018' THEN 'period' ELSE 'size' END AS reason
    FROM f WHERE bad OR NOT hour BETWEEN '24010512' AND '24012018' OR length <= 300""")
def _(table):
    """The log files that are passed over: no hour in the name, outside the period, too small."""
    bad = F.regexp_extract("path", "([0-9]{2})[.]log$", 1).cast("int") % 5 == 0
    files = rendered_files(log_lines(table))
    files = files.withColumn("path", F.when(bad, F.regexp_replace("path", "/([0-9]+[.]log)$", "/x$1")).otherwise(F.col("path")))
    return skipped_files(files, ["/logs"], ["full"], datetime(2024, 1, 5, 12, 30), datetime(2024, 1, 20, 18, 59, 59), min_size=300)


@query("src_decode_by_file", """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Рё' WHEN 1 THEN 'Пользователь ' || user_id ELSE 'no ' || event_id END AS value FROM events""")
def _(table):
    """Files in windows-1251 and in UTF-8; short lines of the first kind are valid in both."""
    # The characters of the sample text that windows-1251 has as single bytes, as latin-1
    wide = "РёПользватеь"
    narrow = wide.encode("cp1251").decode("latin-1")
    i = F.col("event_id")
    value = F.when(i % 3 == 0, "Рё").when(i % 3 == 1, F.concat(F.lit("Пользователь "), F.col("user_id"))).otherwise(F.concat(F.lit("no "), i))
    cp1251 = F.encode(F.translate(value, wide, narrow), "ISO-8859-1").cast("string")
    path = F.concat(F.lit("/logs/"), F.col("user_id") % 10, F.lit(".log"))
    lines = table("events").select("event_id", path.alias("file_path"), F.when(F.col("user_id") % 2 == 0, cp1251).otherwise(value).alias("value"))
    return decode_lines(lines, "file").select("event_id", "value")


# ---- events --------------------------------------------------------------------------------------


@query("evt_frame", """
    SELECT '/logs/full/rphost_' || (user_id % 4) || '/' || strftime(ts, '%y%m%d%H') || '.log' AS file_path,
           CAST(count(*) AS BIGINT) AS events, CAST(2 * count(*) AS BIGINT) AS lines FROM events GROUP BY 1""")
def _(table):
    """Events of all types, many of them cut by the border between two stretches of lines."""
    framed = frame_events(log_lines(table))
    size = F.size(F.split("raw", "<_NL_>"))
    return framed.groupBy("file_path").agg(F.count(F.lit(1)).alias("events"), F.sum(size).alias("lines"))


@query("evt_clean_lines", f"""
    SELECT replace({FIRST}, '""', '<DQ>') || '<_NL_>' || trim({SECOND}) AS raw FROM events""")
def _(table):
    """Lines trimmed, doubled quotes marked, continuation lines joined by the line mark."""
    return frame_events(log_lines(table)).select("raw")


@query("evt_by_type", f"""SELECT "EventId", "Name" FROM (SELECT *, CAST(event_id AS VARCHAR) AS "EventId" FROM ({EV}))
    WHERE "Name" = 'ERROR'""")
def _(table):
    return event_rows(table, "ERROR", ["EventId", "Name"])


@query("evt_period", f"""SELECT CAST(event_id AS VARCHAR) AS "EventId", "timestamp" FROM ({EV})
    WHERE "Name" = 'PURCHASE' AND "timestamp" BETWEEN TIMESTAMP '2024-01-05 12:30:00' AND TIMESTAMP '2024-01-20 18:59:59'""")
def _(table):
    start, end = datetime(2024, 1, 5, 12, 30), datetime(2024, 1, 20, 18, 59, 59)
    return event_rows(table, "PURCHASE", ["EventId", "timestamp"], start=start, end=end)


@query("evt_builtin_columns", f"""
    SELECT "timestamp", "Name", "count", duration, filename, processname FROM ({EV}) WHERE "Name" = 'VIEW'""")
def _(table):
    return event_rows(table, "VIEW", ["timestamp", "Name", "count", "duration", "filename", "processname"])


@query("evt_properties", f"""
    SELECT CAST(event_id AS VARCHAR) AS "EventId", "Usr", "p:processName", "Note", CAST(NULL AS VARCHAR) AS "Inner", "Context"
    FROM ({EV}) WHERE "Name" = 'SIGNUP'""")
def _(table):
    """Bare and quoted values over several lines; a key inside the quotes of a requested one stays hidden."""
    return event_rows(table, "SIGNUP", ["EventId", "Usr", "p:processName", "Note", "Inner", "Context"])


@query("evt_inner_properties", f"""
    SELECT CAST(event_id AS VARCHAR) AS "EventId", "Inner" FROM ({EV}) WHERE "Name" = 'SIGNUP'""")
def _(table):
    """A key inside the quotes of a property nobody asked for is found."""
    return event_rows(table, "SIGNUP", ["EventId", "Inner"])


@query("evt_require_properties", f"""
    SELECT "Usr", CAST("Memory" AS VARCHAR) AS "Memory" FROM ({EV}) WHERE "Name" = 'CLICK' AND "Memory" IS NOT NULL""")
def _(table):
    return event_rows(table, "CLICK", ["Usr", "Memory"], require_all=True)


@query("evt_numeric_coercion", f"""
    SELECT event_id AS "EventId", CAST("Memory" AS DOUBLE) AS "Memory", CAST(NULL AS DOUBLE) AS "Usr"
    FROM ({EV}) WHERE "Name" = 'CLICK'""")
def _(table):
    """Declared types; text that is no number becomes NULL."""
    types = {"EventId": "bigint", "Memory": "double", "Usr": "double"}
    return event_rows(table, "CLICK", ["EventId", "Memory", "Usr"], types=types)


# one key with whole numbers, other numbers and text, as log text and as what its values are
DETAIL = """concat(',Detail=', CASE event_id % 4 WHEN 0 THEN concat(event_id, '.0') WHEN 1 THEN concat('0', event_id)
    WHEN 2 THEN concat(event_id % 50, '.25') ELSE concat('none ', event_id % 9) END)"""
DETAIL_SQL = """SELECT event_id, CASE event_id % 4 WHEN 2 THEN (event_id % 50) + 0.25::DOUBLE WHEN 3 THEN NULL ELSE event_id::DOUBLE END AS num,
    CASE event_id % 4 WHEN 2 THEN (event_id % 50) || '.25' WHEN 3 THEN 'none ' || (event_id % 9) ELSE event_id::VARCHAR END AS shown,
    CASE event_id % 4 WHEN 2 THEN 'DOUBLE' WHEN 3 THEN 'STRING' ELSE 'BIGINT' END AS kind FROM events"""


def mixed_lines(table):
    return render(table("events"), extra=F.expr(DETAIL))


@query("evt_mixed_values", f"""SELECT event_id AS "EventId", kind, shown, num FROM ({DETAIL_SQL})""")
def _(table):
    """One property that holds numbers and text: every value is kept and knows its kind."""
    columns = EventColumns(keys=["EventId", "Detail"], types={"EventId": "bigint", "Detail": "mixed"})
    events, value = log_events(mixed_lines(table), columns), F.col("Detail")
    return events.select("EventId", F.schema_of_variant(value).alias("kind"), mixed.shown(value).alias("shown"), mixed.number(value).alias("num"))


@query("flt_mixed", f"""SELECT event_id AS "EventId", shown AS "Detail" FROM ({DETAIL_SQL})
    WHERE num >= 7.5 AND num < 4000 OR shown = 'none 3' OR contains(shown, 'e 7')""")
def _(table):
    """Filters on values of mixed kind that are kept as Parquet: numbers by order, text by equality and content."""
    lines = mixed_lines(table)
    columns = EventColumns(keys=["EventId", "Detail"], types={"EventId": "bigint", "Detail": "mixed"})
    events = log_events(lines, columns, stage=scratch_folder(lines.sparkSession))
    chosen = [[("ge", 7.5), ("lt", 4000)], [("eq", "none 3")], [("contains", "e 7")]]
    kept = [all_of([Filter("Detail", operation, value) for operation, value in both], events.schema) for both in chosen]
    return events.where(kept[0] | kept[1] | kept[2]).select("EventId", mixed.shown(F.col("Detail")).alias("Detail"))


@query("rep_mixed_listing", f"""SELECT event_id AS "Event", shown AS "Value", round(num * 2 + 1, 3) AS "Twice" FROM ({DETAIL_SQL})""")
def _(table):
    """A listing that calculates with a property and still shows its texts."""
    keys = [
        {"name": "EventId", "alias": "Event", "type": "bigint"}, {"name": "Detail", "alias": "Value"},
        {"name": "twice", "alias": "Twice", "formula": "Detail * 2 + 1"},
    ]
    made = report_lines(mixed_lines(table), {"keys_result": keys, "keys_sort": "Detail desc"})
    return made.withColumn("Value", mixed.shown(F.col("Value")))


@query("agg_mixed_groups", f"""SELECT CASE WHEN kind = 'STRING' THEN shown ELSE CAST(CAST(num AS BIGINT) % 10 AS VARCHAR) END AS "Detail",
    CAST(count(*) AS BIGINT) AS "count", max(event_id) AS "EventId_max" FROM ({DETAIL_SQL}) WHERE kind <> 'DOUBLE' GROUP BY 1""")
def _(table):
    """Groups by a property of mixed kind: `7`, `7.0` and `07` are one group."""
    digit = F.expr("""concat(',Detail=', CASE event_id % 4 WHEN 0 THEN concat(event_id % 10, '.0') WHEN 1 THEN concat('0', event_id % 10) ELSE concat('none ', event_id % 9) END)""")
    lines = render(table("events").where("event_id % 4 <> 2"), extra=digit)
    keys = [{"name": "Detail", "type": "mixed"}, {"name": "count", "aggregation": ["sum"]}, {"name": "EventId", "aggregation": ["max"], "type": "bigint"}]
    made = report_lines(lines, {"keys_result": keys, "keys_aggregate": "Detail"})
    return made.toDF("Detail", "count", "EventId_max")


@query("evt_last_context", f"""
    SELECT CAST(event_id AS VARCHAR) AS "EventId", lastcontext FROM ({EV}) WHERE "Name" = 'VIEW'""")
def _(table):
    return event_rows(table, "VIEW", ["EventId", "lastcontext"])


@query("evt_normalize_sql", f"""
    SELECT CAST(event_id AS VARCHAR) AS "EventId", "Sql" FROM ({EV}) WHERE "Name" = 'ERROR'""")
def _(table):
    return event_rows(table, "ERROR", ["EventId", "Sql"])


@query("evt_round_trip", f"""
    SELECT event_id AS "EventId", "timestamp", "Name", duration, "Usr", "Memory", "Note", "Context" FROM ({EV})""")
def _(table):
    """Every event of every type comes back whole."""
    keys = ["EventId", "timestamp", "Name", "duration", "Usr", "Memory", "Note", "Context"]
    return event_rows(table, None, keys, types={"EventId": "bigint", "Memory": "bigint"})


@query("evt_staged", f"""
    SELECT event_id AS "EventId", "timestamp", "Usr", "Context" FROM ({EV}) WHERE "Name" = 'ERROR'""")
def _(table):
    """One pass over the log, wanted events kept as Parquet in the shared folder."""
    lines = log_lines(table)
    keys = ["EventId", "timestamp", "Usr", "Context"]
    columns = EventColumns(keys=keys, types={"EventId": "bigint"})
    return log_events(lines, columns, "ERROR", stage=scratch_folder(lines.sparkSession)).select(*keys)


@query("set_union_sources", f"""
    SELECT processname, CAST(2 * count(*) AS BIGINT) AS n FROM ({EV}) WHERE "Name" = 'CLICK' GROUP BY 1""")
def _(table):
    """Two log trees read as one."""
    lines = log_lines(table, "/a/full").unionByName(log_lines(table, "/b/full"))
    events = log_events(lines, EventColumns(keys=["processname"]), "CLICK")
    return events.groupBy("processname").agg(F.count(F.lit(1)).alias("n"))
