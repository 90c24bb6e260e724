"""Reports over months, kept up day by day: partial states per group and file hour in a folder of Parquet tables.

`update` reads the hours whose files are new or have grown, and nothing else; `report` merges stored states. Every update is a batch of its own and
adds to the folder; an hour counts by its last batch. The list of a batch's hours is written when its states are
complete, so a batch that fails midway is not seen, and an update that is repeated is not counted twice.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timedelta
from hashlib import sha256
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.states import States, finished, merged, states_of
from logloom.plans.report import apply_times, event_columns, finish, settle_mixed
from logloom.plans.spec import SpecError, parse_spec
from logloom.sources.events import drop_folder, log_events, scratch_folder
from logloom.sources.files import list_log_files
from logloom.sources.lines import read_lines
from logloom.sources.watch import Watch

HOURS = "__hour string, files bigint, bytes bigint, signature string, __batch string"
TABLES = ("groups", "values", "buckets")
HOUR = "%y%m%d%H"


class ReportStore:
    """The stored states of one grouped report. Headers, formulas, sorting and limit may change; what the states depend on may not."""

    def __init__(self, spark: SparkSession, definition: dict[str, Any], path: str, from_files: bool = True):
        self.spark, self.path = spark, path.rstrip("/")
        self.spec = parse_spec(definition, from_files)
        if not self.spec.grouped:
            raise SpecError("only a grouped report has states that can be stored")
        self.keys = list(self.spec.group_by)

    @property
    def signature(self) -> str:
        """What the states depend on, as a digest."""
        s = self.spec
        parts = [
            s.event_name, s.group_by, [[f.key, f.operation, f.value] for f in s.filters], [[k.name, k.aggregates, bool(k.formula), k.roundtime] for k in s.keys],
            sorted(s.property_types.items()), sorted(s.base_directories), sorted(s.base_subdirectories or ()),
        ]
        return sha256(json.dumps(parts, ensure_ascii=False, default=str).encode()).hexdigest()

    # ---- what is there ---------------------------------------------------------------------------

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def hours(self) -> DataFrame:
        """The hours that are stored: `__hour`, `files`, `bytes` and the batch that counts, one row for each."""
        if not self._exists("hours"):
            return self.spark.createDataFrame([], HOURS)
        all_hours = self.spark.read.schema(HOURS).parquet(f"{self.path}/hours")
        last = F.max_by(F.struct("files", "bytes", "signature", "__batch"), "__batch").alias("last")
        return all_hours.groupBy("__hour").agg(last).select("__hour", "last.*")

    def _check(self, hours: DataFrame) -> None:
        if hours.where(F.col("signature") != self.signature).limit(1).collect():
            raise SpecError(f"{self.path} holds the states of another report")

    def _stored(self, hours: DataFrame) -> States | None:
        if not self._exists("groups"):
            return None
        wanted = hours.select("__hour", "__batch")
        found = {n: self.spark.read.parquet(f"{self.path}/{n}").join(wanted, ["__hour", "__batch"], "left_semi").drop("__batch") for n in TABLES if self._exists(n)}
        return States(**{n: found.get(n) for n in TABLES})

    # ---- adding ----------------------------------------------------------------------------------

    def listed(self) -> DataFrame:
        """`__hour`, `files`, `bytes` of the log files in the report's period."""
        s = self.spec
        files = list_log_files(self.spark, list(s.base_directories), list(s.base_subdirectories or ()), s.start, s.end)
        hour = F.substring(F.substring_index("path", "/", -1), 1, 8)
        return files.groupBy(hour.alias("__hour")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))

    def update(self, watch: Watch | None = None, encoding: str | None = "auto") -> list[str]:
        """Read the hours that are not stored as their files are now; gives these hours."""
        known = self.hours()
        self._check(known)
        new = self.listed().join(known, ["__hour", "files", "bytes"], "left_anti").orderBy("__hour").collect()  # one row for each hour of the period
        if not new:
            return []
        names, s = [r["__hour"] for r in new], self.spec
        lines = read_lines(self.spark, list(s.base_directories), list(s.base_subdirectories or ()), hours=names)
        self.add(lines, [tuple(r) for r in new], in_file_order=True, watch=watch, encoding=encoding)
        return names

    def add(
        self, lines: DataFrame, hours: list[tuple[str, int, int]], in_file_order: bool = False, watch: Watch | None = None, encoding: str | None = "auto",
    ) -> None:
        """Store the states of these lines, which are all lines of `hours` (hour, files, bytes)."""
        batch = f"b{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        stage = scratch_folder(self.spark)
        try:
            for name, table in self._states(lines, None, None, stage, in_file_order, watch, encoding).tables.items():
                table.write.parquet(f"{self.path}/{name}/__batch={batch}")
        finally:
            drop_folder(self.spark, stage)
        rows = self.spark.createDataFrame([(*h, self.signature) for h in hours], "__hour string, files bigint, bytes bigint, signature string")
        rows.coalesce(1).write.parquet(f"{self.path}/hours/__batch={batch}")

    def _states(self, lines, start, end, stage, in_file_order, watch=None, encoding="auto") -> States:
        events = log_events(lines, event_columns(self.spec), self.spec.event_name, start, end, in_file_order, encoding, stage, watch)
        events = apply_times(events.withColumn("__hour", F.substring("filename", 1, 8)), self.spec)
        return states_of(settle_mixed(events, self.spec), ["__hour", *self.keys], self.spec.measures)

    # ---- reporting -------------------------------------------------------------------------------

    def report(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """The report over the stored hours from `start` to `end` (as specified by default, both included).

        An hour that the period cuts is read from its log files, if it is stored at all.
        """
        start, end = start or self.spec.start, end or self.spec.end
        hours = self.hours()
        self._check(hours)
        cut, first, last = self._cut(start, end)
        whole = hours
        if first is not None:
            whole = whole.where(F.col("__hour") >= first.strftime(HOUR))
        if last is not None:
            whole = whole.where(F.col("__hour") <= last.strftime(HOUR))
        states = self._stored(whole)
        partly = [r["__hour"] for r in hours.where(F.col("__hour").isin(cut)).collect()] if cut else []  # at most two
        if partly:
            s = self.spec
            lines = read_lines(self.spark, list(s.base_directories), list(s.base_subdirectories or ()), hours=partly)
            fresh = self._states(lines, start, end, scratch_folder(self.spark), True)
            states = fresh if states is None else states.and_those(fresh)
        if states is None:
            raise SpecError(f"nothing is stored in {self.path} yet")
        return finish(finished(merged(states, self.keys), self.keys, self.spec.measures), self.spec, self._loose())

    def _loose(self) -> tuple[str, ...]:
        wanted = event_columns(self.spec)
        return tuple(k for k in wanted.properties if k not in wanted.types)

    @staticmethod
    def _cut(start: datetime | None, end: datetime | None) -> tuple[list[str], datetime | None, datetime | None]:
        """The hours that a period cuts, and the first and last hour that lie in it as a whole."""
        cut, first, last, hour = [], start, end, timedelta(hours=1)
        if start is not None:
            first = start.replace(minute=0, second=0, microsecond=0)
            if start != first:
                cut, first = [first.strftime(HOUR)], first + hour
        if end is not None:
            last = end.replace(minute=0, second=0, microsecond=0)
            if end < last + hour - timedelta(seconds=1):
                cut, last = [*cut, last.strftime(HOUR)], last - hour
        return list(dict.fromkeys(cut)), first, last
