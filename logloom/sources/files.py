"""Log files: discovery by directory name, pruning by hour and size, inventory.

`select_log_files` works on any `(path, length)` DataFrame. `log_text_scans` puts the same choice into
predicates on the text scan's constant `_metadata` fields, which Spark applies to its file listing:
files outside the choice are never opened, and no list of paths passes through the driver program.
"""

from __future__ import annotations

import logging
import re
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.times import file_hour, ntz

log = logging.getLogger(__name__)

# What counts as a log file.
LOG_GLOB = "*.log"
MIN_SIZE = 20


def _path_part(path: Column) -> Column:
    """A path without scheme and authority."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")


def _outermost(dirs: list[str]) -> list[str]:
    """Drop directories that repeat or lie below another one: the outer one finds their files too."""
    clean = list(dict.fromkeys(d.strip().rstrip("/") or "/" for d in dirs))
    return [d for d in clean if not any(d != other and d.startswith(other.rstrip("/") + "/") for other in clean)]


def in_directories(path: Column, dirs: list[str], subdirs: list[str]) -> Column:
    """Whether a file lies in a directory of a listed name, looking from each base's own name downward."""
    parts = F.split(F.regexp_replace(_path_part(path), "/[^/]*$", ""), "/")
    names = F.array(*[F.lit(s) for s in subdirs])

    def under(base: str) -> Column:
        depth = len(base.rstrip("/").split("/"))
        below = F.slice(parts, depth, F.greatest(F.size(parts) - depth + 1, F.lit(0)))
        return F.startswith(_path_part(path), F.lit(base.rstrip("/") + "/")) & F.arrays_overlap(below, names)

    return reduce(or_, [under(d) for d in _outermost(dirs)])


def in_period(name: Column, start: datetime | None, end: datetime | None) -> Column:
    """Whether a file name's hour touches the period; false for names without a valid hour."""
    hour = file_hour(name)
    keep = hour.isNotNull()
    if start is not None:
        keep &= hour >= ntz(start.replace(minute=0, second=0, microsecond=0))
    if end is not None:
        keep &= hour <= ntz(end)
    return keep


def select_log_files(
    files: DataFrame,
    dirs: list[str] | None = None,
    subdirs: list[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    min_size: int = MIN_SIZE,
    prune: bool = True,
) -> DataFrame:
    """Choose from `(path, length)`: by directory name, then (`prune`) by hour and size. Each path once."""
    chosen = files.select("path", "length")
    if dirs and subdirs is not None:
        chosen = chosen.where(in_directories(F.col("path"), dirs, subdirs) if subdirs else F.lit(False))
    if prune:
        name = F.substring_index("path", "/", -1)
        chosen = chosen.where(in_period(name, start, end) & (F.col("length") > min_size))
    return chosen.distinct()


def skip_reason(name: Column, length: Column, start: datetime | None, end: datetime | None, min_size: int = MIN_SIZE) -> Column:
    """Why a log file is not read: `name` (it has no valid hour), `period` or `size`; NULL if it is."""
    return (
        F.when(file_hour(name).isNull(), "name").when(~in_period(name, start, end), "period").when(length <= min_size, "size")
    )


def skipped_files(
    files: DataFrame, dirs: list[str] | None = None, subdirs: list[str] | None = None, start: datetime | None = None, end: datetime | None = None,
    min_size: int = MIN_SIZE,
) -> DataFrame:
    """`(path, length, reason)` of the log files in the right directories that are not read, from `(path, length)`."""
    chosen = select_log_files(files, dirs, subdirs, prune=False)
    reason = skip_reason(F.substring_index("path", "/", -1), F.col("length"), start, end, min_size)
    return chosen.withColumn("reason", reason).where("reason IS NOT NULL")


def file_inventory(files: DataFrame) -> DataFrame:
    """Number of files and their total size in MB, as one row."""
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("length") / F.lit(1024 * 1024), F.lit(0.0)).alias("total_mb"),
    )


def _existing(spark: SparkSession, dirs: list[str]) -> list[tuple[str, str]]:
    """(directory, its fully qualified URI) for the base directories that exist."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for directory in _outermost(dirs):
        path = jvm.org.apache.hadoop.fs.Path(directory)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            found.append((directory, fs.makeQualified(path).toUri().toString()))
        else:
            log.warning("base directory not found, skipped: %s", directory)
    return found


def _no_glob(directory: str) -> str:
    """A directory name as a read path: Spark would take brackets and wildcards in it for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", directory)


def _encoded(spark: SparkSession, name: str) -> str:
    """A directory name as it stands in `_metadata.file_path`."""
    return spark._jvm.org.apache.hadoop.fs.Path("/" + name).toUri().toString()[1:]


def _listed(spark: SparkSession, dirs: list[str]) -> tuple[DataFrame, list[str]]:
    """`(path, length)` of all log files below the base directories that exist, and these directories."""
    found = _existing(spark, dirs)
    if not found:
        return spark.createDataFrame([], "path string, length bigint"), []
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", LOG_GLOB)
        .load([_no_glob(directory) for directory, _ in found])
        .select("path", "length")
    )
    return listing, [spark._jvm.org.apache.hadoop.fs.Path(d).toUri().getPath() for d, _ in found]


def list_log_files(
    spark: SparkSession,
    dirs: list[str],
    subdirs: list[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    min_size: int = MIN_SIZE,
    prune: bool = True,
) -> DataFrame:
    """`(path, length)` of the log files below the base directories; contents are not read."""
    listing, bases = _listed(spark, dirs)
    return select_log_files(listing, bases, subdirs, start, end, min_size, prune)


def list_skipped_files(
    spark: SparkSession, dirs: list[str], subdirs: list[str] | None = None, start: datetime | None = None, end: datetime | None = None, min_size: int = MIN_SIZE,
) -> DataFrame:
    """`(path, length, reason)` of the log files below the base directories that a report does not read."""
    listing, bases = _listed(spark, dirs)
    return skipped_files(listing, bases, subdirs, start, end, min_size)


def log_text_scans(
    spark: SparkSession,
    dirs: list[str],
    subdirs: list[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    min_size: int = MIN_SIZE,
    glob: str | None = None,
    hours: list[str] | None = None,
) -> list[DataFrame]:
    """One text scan per base directory, over its chosen files, with `_metadata` still available.

    `hours` (yymmddhh) may name the hours whose files are read.

    The predicates are plain substring tests because Spark also repeats them per row. They may let
    a badly named file through; its events have no valid time and are dropped later.
    """
    path, name = F.col("_metadata.file_path"), F.substring(F.col("_metadata.file_name"), 1, 8)
    scans = []
    for directory, uri in _existing(spark, dirs):
        scan = (
            spark.read.option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob or LOG_GLOB)
            .text(_no_glob(directory))
            .where(F.col("_metadata.file_size") > min_size)
        )
        if start is not None:
            scan = scan.where(name >= start.strftime("%y%m%d%H"))
        if end is not None:
            scan = scan.where(name <= end.strftime("%y%m%d%H"))
        if hours is not None:
            scan = scan.where(name.isin(hours))
        if subdirs is not None:
            # from the slash before the base's own name onward
            below = F.substr(path, F.lit(uri.rstrip("/").rfind("/") + 1))
            tests = [F.contains(below, F.lit(f"/{_encoded(spark, s)}/")) for s in subdirs]
            scan = scan.where(reduce(or_, tests, F.lit(False)))
        scans.append(scan)
    return scans
