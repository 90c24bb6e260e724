"""Writing report tables."""

from __future__ import annotations

import os
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from logloom.functions import mixed
from logloom.functions.columns import col
from logloom.sources.events import drop_folder, scratch_folder
from logloom.sources.watch import Watch

FORMATS = ("csv", "parquet", "json")


# How CSV tables are written and read: quotes are doubled, and nothing is trimmed.
CSV = {"header": True, "escape": '"', "encoding": "UTF-8", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """Write a report as a Spark table folder; CSV has a header line, quotes multi-line text and shows values of mixed kind as text.

    With `overwrite` the new table is written beside the old one and takes its place by a rename once it is complete; if the
    job fails, the old table stays as it was. (Where renaming copies, as in object stores, readers may see that happen.)
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown report format {fmt!r}: use one of {FORMATS}")
    if fmt == "csv":
        df = df.select(*[mixed.shown(col(f.name)).alias(f.name) if isinstance(f.dataType, T.VariantType) else col(f.name) for f in df.schema])
    options = CSV if fmt == "csv" else {}
    if mode != "overwrite":
        df.write.mode(mode).format(fmt).options(**options).save(path)
        return path
    place = _Place(df.sparkSession, path)
    place.put_back()
    try:
        df.write.format(fmt).options(**options).save(place.new)
    except Exception:
        drop_folder(df.sparkSession, place.new)
        raise
    place.replace()
    return path


def read_table(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str | None = None) -> DataFrame:
    """A table that `write_table` has written; without a `schema` the columns of CSV are text. CSV gives empty text back as NULL."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(**CSV, multiLine=True)
    return (reader if schema is None else reader.schema(schema)).load(path)


class _Place:
    """Where a table lies, and hidden names beside it for the one that is being written and the one that it replaces."""

    def __init__(self, spark: SparkSession, path: str):
        parent, _, name = path.rstrip("/").rpartition("/")
        beside = f"{parent}/_{name}" if parent or path.startswith("/") else f"_{name}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.table, self.new, self.old = path.rstrip("/"), f"{beside}.{uuid.uuid4().hex}.new", f"{beside}.old"

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _move(self, source: str, target: str) -> None:
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot rename {source} to {target}")

    def put_back(self) -> None:
        """Undo a replacement that was broken off between its two renames."""
        if self._exists(self.old) and not self._exists(self.table):
            self._move(self.old, self.table)

    def replace(self) -> None:
        """The new table takes the place of the old one."""
        if self._exists(self.table):
            self._fs.delete(self._path(self.old), True)
            self._move(self.table, self.old)
        try:
            self._move(self.new, self.table)
        except Exception:
            self.put_back()
            self._fs.delete(self._path(self.new), True)
            raise
        self._fs.delete(self._path(self.old), True)


def _target(definition: dict[str, Any]) -> str:
    """Where a specification wants its report."""
    stem, ending = os.path.splitext(definition.get("output_file") or "report")
    if ending.lower() not in (".xlsx", ".csv", ".parquet", ".json"):
        stem += ending
    return f"{str(definition.get('output_directory') or '.').rstrip('/')}/{stem}"


def write_reports(spark: SparkSession, definitions: list[dict[str, Any]], fmt: str = "csv", encoding: str | None = "auto") -> list[str]:
    """Run several reports over log files, reading these once, and write each to its place."""
    from logloom.plans.report import run_reports

    paths = [_target(d) for d in definitions]
    if len(set(paths)) < len(paths):
        raise ValueError(f"several reports would be written to the same place: {paths}")
    folder = scratch_folder(spark)
    try:
        return [write_table(made, path, fmt) for made, path in zip(run_reports(spark, definitions, encoding, folder), paths)]
    finally:
        drop_folder(spark, folder)


def write_report(
    spark: SparkSession, definition: dict[str, Any], fmt: str = "csv", encoding: str | None = "auto", watch: Watch | None = None,
) -> str:
    """Run the report over log files and write it to `<output_directory>/<output_file>`.

    The events staged on the way are removed again. A `watch` counts what is left out.
    """
    from logloom.plans.report import run_report

    path, folder = _target(definition), scratch_folder(spark)
    try:
        return write_table(run_report(spark, definition, encoding=encoding, folder=folder, watch=watch), path, fmt)
    finally:
        drop_folder(spark, folder)
