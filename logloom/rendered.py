"""A table of events written out as log lines, for checks and benchmarks of the log source.

`(file_path, block, pos, sole, value)` as the text scan would give them, made by Spark from the columns
`event_id, ts, user_id, event_type, value`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lines per stretch that stands for a split; odd, so that two-line events straddle the borders.
STRETCH = 37


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def rendered_path(root: str = "/logs/full") -> Column:
    process = F.pmod(F.col("user_id"), F.lit(4))
    return _text(f"{root}/rphost_", process, "/", F.date_format("ts", "yyMMddHH"), ".log")


def first_line(extra: Column | str = "") -> Column:
    """Start line: some properties are always there, `Memory` and `Note` only for some events; `extra` is text with more."""
    i, user = F.col("event_id"), F.col("user_id")
    memory = F.when(i % 3 != 0, _text(",Memory=", i * 8)).otherwise(F.lit(""))
    note = F.when(i % 4 == 0, _text(',Note="said ""hi"" ,Inner=nobody ', i % 5, ', ok"')).otherwise(F.lit(""))
    sql = _text(
        ",Sql=\"SELECT c", i % 3, " FROM pg_temp.tt", i, " WHERE b = 'x", user, "' AND c = ", i, " AND d > 1.5\""
    )
    return _text(
        F.date_format("ts", "mm:ss.SSSSSS"), "-", F.round(F.col("value") * 1_000_000).cast("bigint"), ",",
        F.upper("event_type"), ",1,process=rphost,p:processName=base", user % 5, ",Usr=U", user,
        ",EventId=", i, memory, note, sql, extra, ",Context='step ", i % 7,
    )


def second_line() -> Column:
    return _text("   last ", F.col("event_id") % 5, "'  ")


def render(events: DataFrame, root: str = "/logs/full", extra: Column | str = "") -> DataFrame:
    """Two lines per event."""
    lines = F.posexplode(F.array(first_line(extra), second_line())).alias("n", "value")
    pos = (F.col("event_id") * 2 + F.col("n")).alias("pos")
    return (
        events.select(rendered_path(root).alias("file_path"), "event_id", lines)
        .select("file_path", pos, F.lit(False).alias("sole"), "value")
        .withColumn("block", F.col("pos") - F.pmod(F.col("pos"), F.lit(STRETCH)))
        .select("file_path", "block", "pos", "sole", "value")
    )


def rendered_files(lines: DataFrame) -> DataFrame:
    """`(path, length)` of the files these lines would fill."""
    size = F.sum(F.octet_length("value") + 2).alias("length")
    return lines.groupBy(F.col("file_path").alias("path")).agg(size)
