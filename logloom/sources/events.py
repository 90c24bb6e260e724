"""Typed event rows from framed events: built-in columns, properties, filters."""

from __future__ import annotations

import atexit
import uuid
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logloom.functions import mixed, regex, text
from logloom.functions.columns import col, with_computed
from logloom.functions.times import event_time
from logloom.operators.filters import Filter, all_of
from logloom.sources.encodings import BY_FILE, file_votes
from logloom.sources.framing import WHOLE, event_fragments, frame_events, stitch, unowned_lines, with_raw
from logloom.sources.watch import Watch

# Columns every event has.
BUILT_IN = ("timestamp", "Name", "count", "duration", "filename", "processname")

# Columns derived from a property, and the property.
DERIVED = {"lastcontext": "Context"}

# Fixed value: the property that holds SQL text.
SQL_PROPERTY = "Sql"

# The place of a staged row: its file, and its number in it.
PLACE = ("__file", "__row")

TYPES = ("string", "double", "bigint", "mixed")


@dataclass(frozen=True)
class EventColumns:
    """Which columns an event gets.

    `keys` may name built-in, derived and plain properties. Events without every property behind
    `keys` are dropped if `require_all`; `extra` properties are read too but never required. `types`
    declares numeric properties and those of mixed kind; the rest are text.
    """

    keys: list[str]
    extra: list[str] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)
    filters: list[Filter] = field(default_factory=list)
    require_all: bool = True

    @staticmethod
    def _sources(keys: list[str]) -> list[str]:
        return list(dict.fromkeys(DERIVED.get(k, k) for k in keys if k not in BUILT_IN))

    @property
    def required(self) -> list[str]:
        return self._sources(self.keys) if self.require_all else []

    @property
    def properties(self) -> list[str]:
        return self._sources([*self.keys, *self.extra])

    @property
    def derived(self) -> list[str]:
        return [k for k in dict.fromkeys([*self.keys, *self.extra]) if k in DERIVED]


def decoded_path(path: Column) -> Column:
    """A path from `_metadata.file_path`, which is URL-encoded, as people write it."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(path, F.lit("%")), plain).otherwise(path)


def has_properties(raw: Column, keys: list[str]) -> Column:
    """Whether every key occurs as `,key=` in the event."""
    return reduce(and_, [F.contains(raw, F.lit(f",{k}=")) for k in keys], F.lit(True))


def _header(raw: Column) -> Column:
    return F.substring_index(raw, ",", 1)


def _name(raw: Column) -> Column:
    return F.split_part(raw, F.lit(","), F.lit(2))


def is_event_text(raw: Column) -> Column:
    """Whether an event has a plain name and something after it."""
    return raw.rlike(r"(?s)^[^,]*,[A-Za-z]+,.")


def key_values(raw: Column) -> Column:
    """The event text after its name."""
    return F.substr(raw, F.length(_header(raw)) + F.length(_name(raw)) + 3)


def built_in_columns(file_path: Column, raw: Column) -> dict[str, Column]:
    parts = F.split(file_path, "/")
    file_name = F.substring_index(file_path, "/", -1)
    return {
        "timestamp": event_time(file_name, raw),
        "Name": _name(raw),
        "count": F.lit(1).cast("bigint"),
        "duration": F.substring_index(_header(raw), "-", -1).try_cast("double") / F.lit(1_000_000.0),
        "filename": decoded_path(file_name),
        "processname": decoded_path(F.try_element_at(parts, F.lit(-2))),
    }


def property_pattern(keys: list[str]) -> str:
    """One pattern for all keys, so that a key inside another key's quotes stays hidden."""
    names = "|".join(regex.escape(k) for k in keys)
    return rf""",({names})=(?:"[^"]*"|'[^']*'|[^,\r\n]+)"""


def property_value(found: Column, key: str) -> Column:
    """The value of the last `,key=value` among the matches, unquoted and with its marks restored."""
    prefix = f",{key}="
    last = F.try_element_at(F.filter(found, lambda m: F.startswith(m, F.lit(prefix))), F.lit(-1))
    value = F.substr(last, F.lit(len(prefix) + 1))
    quoted = (
        (F.length(value) >= 2)
        & F.left(value, F.lit(1)).isin('"', "'")
        & (F.left(value, F.lit(1)) == F.right(value, F.lit(1)))
    )
    value = text.strip(F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value))
    if key == SQL_PROPERTY:
        value = text.normalize_sql(value)
    return text.restore_quotes(value)


def extract_properties(framed: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Add one text column per key; NULL where the event has no such property."""
    if not keys:
        return framed
    pattern = F.lit(property_pattern(keys))
    found = with_computed(framed, "__found", F.regexp_extract_all(key_values(F.col(raw)), pattern, F.lit(0)))
    values = [property_value(F.col("__found"), k).alias(k) for k in keys]
    return found.select(*[col(c) for c in framed.columns if c not in keys], *values)


def typed(c: Column, kind: str) -> Column:
    """Property text as its declared type."""
    if kind == "double":
        return text.to_number(c)
    if kind == "bigint":
        return text.to_integer(c)
    if kind == "mixed":
        return mixed.from_text(c)
    return c


def parse_events(framed: DataFrame, columns: EventColumns, aside: str | None = None, watch: Watch | None = None) -> DataFrame:
    """Event rows from framed events (`file_path`, `raw`).

    Rows in which the column `aside` is filled are no events yet and pass through with it.
    """
    raw = F.col("raw")
    unknown = {k: t for k, t in columns.types.items() if t not in TYPES}
    if unknown:
        raise ValueError(f"unknown property types {unknown}: use one of {TYPES}")

    def passes(condition: Column) -> Column:
        return condition if aside is None else F.col(aside).isNotNull() | condition

    beside = [aside] if aside else []
    rows = framed.select("file_path", "raw", *beside)
    mine = F.lit(True) if aside is None else F.col(aside).isNull()
    plain, whole = is_event_text(raw), has_properties(raw, columns.required)
    if watch is not None:
        rows = watch.over(rows, malformed=F.count_if(mine & ~plain), incomplete=F.count_if(mine & plain & ~whole))
    rows = rows.where(passes(plain & whole))
    rows = extract_properties(rows, columns.properties)
    built_in = built_in_columns(F.col("file_path"), raw)
    derived = {k: text.last_line(col(DERIVED[k])).alias(k) for k in columns.derived}
    rows = rows.select(
        *[c.alias(k) for k, c in built_in.items()],
        *derived.values(),
        *[text.restore_newlines(col(k)).alias(k) for k in columns.properties],
        *beside,
    )
    # filters see property text; whether it counts as a number is decided value by value
    chosen = all_of(columns.filters, rows.schema, loose=columns.properties)
    if watch is not None:
        kept = F.coalesce(chosen, F.lit(False))
        rows = watch.over(rows, filtered=F.count_if(mine & ~kept), events=F.count_if(mine & kept))
    rows = rows.where(passes(chosen))
    wanted = [*columns.properties, *columns.derived]
    return rows.select(
        *[col(k) for k in BUILT_IN],
        *[typed(col(k), columns.types.get(k, "string")).alias(k) for k in wanted],
        *beside,
    )


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared `spark.checkpoint.dir`; a local one only in local mode.

    What is in it goes when the program ends, if it has not been dropped before (see `drop_folder`).
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="logloom-")
    folder = f"{shared.rstrip('/')}/logloom-{uuid.uuid4().hex}"
    atexit.register(_drop_quietly, spark._jvm, spark._jsc.hadoopConfiguration(), folder)
    return folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder in whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _drop_quietly(jvm, configuration, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(configuration).delete(path, True)
    except Exception:  # the JVM went first
        pass


def stored_votes(lines: DataFrame, stage: str) -> DataFrame:
    """The encodings of all files, from a reading of their own that is done once and kept beside the events."""
    votes, path = file_votes(lines), f"{stage}/_votes"
    votes.write.mode("overwrite").parquet(path)
    return lines.sparkSession.read.schema(votes.schema).parquet(path)


def _read_back(spark: SparkSession, schema: StructType, path: str, located: bool) -> DataFrame:
    df = spark.read.schema(schema).parquet(path)
    return df.withColumns(dict(zip(PLACE, (F.col("_metadata.file_path"), F.col("_metadata.row_index"))))) if located else df


def log_events(
    lines: DataFrame,
    columns: EventColumns,
    event_name: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    in_file_order: bool = False,
    encoding: str | None = "auto",
    stage: str | None = None,
    watch: Watch | None = None,
    located: bool = False,
) -> DataFrame:
    """Event rows from log lines.

    Without `stage` the result is a lazy plan that passes over the lines twice, once for events inside
    a split and once for those on split borders, and again for every use of the result. With `stage`,
    a folder, the log is read once: finished rows and the few border fragments are written there as
    Parquet, evened out into files of a good size, and the result reads them back, column by column;
    the text of border fragments is read only to put those together. A `watch` counts what is left out; its counts are
    complete when this returns. Files are then as the scan gives them, since a shuffle could count a repeated task twice.
    `located` adds the place of each row in the staged files (PLACE). With the encoding `file` each file has one, told from all its lines by a reading that comes before.
    """
    if stage is None:
        if watch is not None:
            raise ValueError("what is left out can be counted only while events are staged")
        framed = frame_events(lines, event_name, start, end, in_file_order, encoding)
        return parse_events(framed, columns)

    spark = lines.sparkSession
    votes = stored_votes(lines, stage) if encoding == BY_FILE else None
    fragments = event_fragments(lines, event_name, start, end, in_file_order, watch)
    rim = F.when(F.col("role") != WHOLE, F.struct(*fragments.columns))
    marked = fragments.withColumn("__rim", rim)
    once = with_raw(marked, ["file_path", "__rim"], encoding, votes, only=F.col("role") == WHOLE)
    rows = parse_events(once, columns, aside="__rim", watch=watch)
    # the rows hold extracted columns of wanted events only, so evening them out is cheap beside the scan
    flagged = rows.withColumn("__crosses", F.col("__rim").isNotNull())
    place = stage if watch is None and votes is None and not located else f"{stage}/inside"
    (flagged.hint("rebalance") if watch is None else flagged).write.mode("overwrite").parquet(place)
    saved = _read_back(spark, flagged.schema, place, located)
    rims = saved.where("__crosses").select("__rim.*")
    crossing = parse_events(with_raw(stitch(rims), ["file_path"], encoding, votes), columns, watch=watch)
    if watch is not None:
        watch.add("lost_lines", unowned_lines(rims))
    if watch is not None or located:
        crossing.write.mode("overwrite").parquet(f"{stage}/crossing")
        crossing = _read_back(spark, crossing.schema, f"{stage}/crossing", located)
    return saved.where("NOT __crosses").drop("__rim", "__crosses").unionByName(crossing)
