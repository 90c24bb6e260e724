"""Raw log lines, read in splits, with the position data that framing needs.

Columns: `file_path` (as in `_metadata.file_path`, i.e. URL-encoded), `block` (start offset of the
split), `pos` (increasing inside a split), `sole` (the split is the whole file), `value`. Unless an
encoding is given, `value` keeps the bytes of the file: framing needs ASCII only, and decoding the
lines of wanted events later is much less work than decoding every line.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import decode_text
from logloom.sources.encodings import BY_FILE, file_votes, with_votes
from logloom.sources.files import MIN_SIZE, log_text_scans

LINES_SCHEMA = "file_path string, block bigint, pos bigint, sole boolean, value string"


def decode_lines(lines: DataFrame, encoding: str = "auto") -> DataFrame:
    """Decode the bytes in `value`; with the encoding `file`, each file's by the vote of all its lines."""
    if encoding == BY_FILE:
        voted = with_votes(lines, file_votes(lines))
        return voted.withColumn("value", decode_text(F.col("value"), F.col("__cp1251"))).select(*lines.columns)
    return lines.withColumn("value", decode_text(F.col("value"), encoding))


def read_lines(
    spark: SparkSession,
    dirs: list[str],
    subdirs: list[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    min_size: int = MIN_SIZE,
    encoding: str | None = None,
    glob: str | None = None,
    hours: list[str] | None = None,
) -> DataFrame:
    """Lines of the chosen log files. Large files are split; rows of a split come in file order.

    `hours` (yymmddhh, as in file names) may name the hours whose files are read.
    """
    scans = [
        scan.select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
            (F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("sole"),
            "value",
        )
        for scan in log_text_scans(spark, dirs, subdirs, start, end, min_size, glob, hours)
    ]
    if not scans:
        return spark.createDataFrame([], LINES_SCHEMA)
    lines = reduce(DataFrame.unionByName, scans)
    return decode_lines(lines, encoding) if encoding else lines
