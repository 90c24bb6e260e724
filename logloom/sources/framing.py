"""Events from lines: a start line and the lines that continue it, across split borders.

Inside a split the grouping is narrow. The scan delivers a split's lines in file order, so one pass
over its Arrow batches turns runs of lines into list rows; the text is never shuffled or sorted, and
only the open run is held in memory. Spark has no built-in narrow operator that looks at neighbouring
rows, a window would shuffle and sort all raw text. Pattern matching stays in Spark expressions, the
Python side works on whole Arrow columns.

Only the two fragments at the rims of a split can belong to an event that crosses a border: the lines
before its first start (HEAD) and its last event (TAIL). These few rows are put together by file.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.columns import with_computed
from logloom.functions.text import NEWLINE_MARK, clean_line, decode_text
from logloom.functions.times import event_time, ntz
from logloom.sources.encodings import BY_FILE, file_votes, with_votes
from logloom.sources.watch import Watch

# Fixed value: how the first line of an event begins (minute, second, fraction, duration).
EVENT_START = r"^[0-9]{2}:[0-9]{2}\.[0-9]+-[0-9]+,"

WHOLE, HEAD, TAIL, LOST = 0, 1, 2, 3
START, WANTED, SOLE, FLAG_BITS = 1, 2, 4, 3

FRAGMENT_SCHEMA = (
    "id_a bigint, id_b bigint, block bigint, seq bigint, role int, wanted boolean, "
    "file_path string, lines array<string>"
)


def is_start(line: Column) -> Column:
    """Whether a line starts an event of any type."""
    cheap = (F.substring(line, 3, 1) == ":") & (F.substring(line, 6, 1) == ".")
    return F.coalesce(cheap & line.rlike(EVENT_START), F.lit(False))


def is_wanted(
    file_path: Column, line: Column, event_name: str | tuple[str, ...] | None, start: datetime | None, end: datetime | None
) -> Column:
    """For a start line: right event type (or one of several), valid time, time in the period (both ends included)."""
    at = event_time(F.substring_index(file_path, "/", -1), line)
    keep = at.isNotNull()
    if start is not None:
        keep &= at >= ntz(start)
    if end is not None:
        keep &= at <= ntz(end)
    if event_name is not None:
        keep = has_name(line, event_name) & keep
    return F.coalesce(keep, F.lit(False))


def has_name(line: Column, event_name: str | tuple[str, ...]) -> Column:
    """Whether an event's type, which stands between the first two commas, is this one, or one of these."""
    names = (event_name,) if isinstance(event_name, str) else event_name
    return reduce(or_, [F.instr(line, f",{name},") == F.instr(line, ",") for name in names])


def is_untimed(file_path: Column, line: Column, event_name: str | None) -> Column:
    """For a start line: right event type, but no valid time."""
    untimed = event_time(F.substring_index(file_path, "/", -1), line).isNull()
    return untimed if event_name is None else has_name(line, event_name) & untimed


def _run_grouper(count_lost: bool = False):
    """The function for mapInArrow; self-contained, so that executors need no copy of this package.

    Input: `id_a, block, tag, file_path, value`. `tag` holds more bits of the file's identity above
    three flag bits (START, WANTED, SOLE): every column costs time for every line of text.
    `file_path` is there on wanted starts only. Output: FRAGMENT_SCHEMA. With `count_lost` there is also a row
    for the lines before the first start of a whole file: role LOST, their number as `seq`, and no text.
    """
    import numpy as np
    import pyarrow as pa

    whole, head, tail, lost = WHOLE, HEAD, TAIL, LOST
    start_bit, wanted_bit, sole_bit, shift = START, WANTED, SOLE, FLAG_BITS
    names = ["id_a", "id_b", "block", "seq", "role", "wanted", "file_path", "lines"]

    def to_rows(split, seq, role, wanted, path, lines):
        split = [pa.array(part, pa.int64()) for part in split]
        rest = [pa.array(seq, pa.int64()), pa.array(role, pa.int32()), pa.array(wanted, pa.bool_())]
        return pa.RecordBatch.from_arrays([*split, *rest, path, lines], names=names)

    def lost_rows(*split, size, path):
        none = pa.ListArray.from_arrays(pa.array([0] * (len(size) + 1), pa.int32()), pa.array([], pa.string()))
        return to_rows(split, size, [lost] * len(size), [False] * len(size), path, none)

    def close(run, last):
        """The row for a run that reached across batches, if it is needed."""
        role = head if not run["start"] else tail if last and not run["sole"] else whole
        if role == head and run["sole"] and count_lost:
            return lost_rows(*[[v] for v in run["split"]], size=[run["size"]], path=run["path"])
        if (role == whole and not run["wanted"]) or (role == head and run["sole"]):
            return None
        text = pa.concat_arrays(run["lines"]) if run["lines"] else pa.array([], pa.string())
        lines = pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), text)
        split = [[part] for part in run["split"]]
        return to_rows(split, [run["seq"]], [role], [run["wanted"]], run["path"], lines)

    def group(batches):
        run = None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            id_a, block, tag = (batch.column(i).to_numpy() for i in range(3))
            path, text = batch.column(3), batch.column(4)
            split = [id_a, tag >> shift, block]
            start, wanted, sole = ((tag & bit) != 0 for bit in (start_bit, wanted_bit, sole_bit))

            new_split = np.zeros(n, bool)
            for i, part in enumerate(split):
                new_split[1:] |= part[1:] != part[:-1]
                new_split[0] |= run is None or run["split"][i] != part[0]

            at = np.flatnonzero(start | new_split)
            lead = at[0] if len(at) else n
            if run is not None:
                run["size"] += int(lead)
            if lead and run["keep"]:
                run["lines"].append(text.slice(0, lead))
            if not len(at):
                continue

            opens, fresh = start[at], new_split[at]
            if run is not None:
                row = close(run, last=bool(fresh[0]))
                if row is not None:
                    yield row

            # number the events of a split from 1; what stands before its first start is number 0
            total = np.cumsum(opens)
            before = np.maximum.accumulate(np.where(fresh, total - opens, 0))
            seq = total - before
            if run is not None:
                seq = seq + np.where(np.cumsum(fresh) == 0, run["seq"], 0)

            # all but the last run end inside this batch
            done = len(at) - 1
            first, size = at[:done], np.diff(at)
            ok, alone = wanted[first], sole[first]
            role = np.where(~opens[:done], head, np.where(fresh[1:] & ~alone, tail, whole))
            needed = np.where(role == whole, ok, np.where(role == head, ~alone, True))
            unowned = np.flatnonzero((role == head) & alone)
            if count_lost and len(unowned):
                yield lost_rows(*[part[first[unowned]] for part in split], size=size[unowned], path=path.take(pa.array(first[unowned])))
            if needed.any():
                with_text = needed & ((role == head) | ok)
                lines = text.slice(at[0], at[-1] - at[0]).filter(pa.array(np.repeat(with_text, size)))
                ends = np.cumsum(np.where(with_text, size, 0)[needed])
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                pick = np.flatnonzero(needed)
                yield to_rows(
                    [part[first[pick]] for part in split], seq[pick], role[pick], ok[pick],
                    path.take(pa.array(first[pick])), pa.ListArray.from_arrays(offsets, lines),
                )

            i = int(at[-1])
            run = {
                "split": [part[i] for part in split], "seq": int(seq[-1]), "sole": bool(sole[i]),
                "start": bool(opens[-1]), "wanted": bool(wanted[i]), "path": path.slice(i, 1), "lines": [], "size": n - i,
            }
            run["keep"] = run["wanted"] if run["start"] else not run["sole"]
            if run["keep"]:
                run["lines"].append(text.slice(i))
        if run is not None:
            row = close(run, last=True)
            if row is not None:
                yield row

    return group


def event_fragments(
    lines: DataFrame,
    event_name: str | tuple[str, ...] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    in_file_order: bool = False,
    watch: Watch | None = None,
) -> DataFrame:
    """Wanted events that lie inside one split, plus the fragments at the rims of every split.

    `in_file_order` says that rows arrive as a text scan delivers them. Other line tables are first
    brought into that order, a split at a time. Between the two sides a file is known by a 96-bit
    hash of its path; the path itself travels with wanted events only, not with every line.
    """
    if "sole" not in lines.columns:
        lines = lines.withColumn("sole", F.lit(False))
    if not in_file_order:
        lines = lines.repartition("file_path", "block").sortWithinPartitions("file_path", "block", "pos")
    path, value, flags = F.col("file_path"), F.col("value"), F.col("flags")
    wanted = is_wanted(path, value, event_name, start, end)
    marked = lines.select(
        "file_path", "block", "sole", "value",
        F.when(~is_start(value), 0).when(wanted, START + WANTED).otherwise(START).alias("flags"),
    )
    if watch is not None:
        marked = watch.over(marked, untimed=F.count_if((flags == START) & is_untimed(path, value, event_name)))
    sole = F.when(F.col("sole"), SOLE).otherwise(0)
    shipped = marked.select(
        F.xxhash64(path).alias("id_a"),
        "block",
        (F.shiftleft(F.hash(path).cast("bigint"), FLAG_BITS) + sole + flags).alias("tag"),
        F.when(flags == START + WANTED, path).alias("file_path"),
        # the text of an unwanted start line is not needed past this point
        F.when(flags != START, value).alias("value"),
    )
    if watch is None:
        return shipped.mapInArrow(_run_grouper(), FRAGMENT_SCHEMA)
    fragments = shipped.mapInArrow(_run_grouper(count_lost=True), FRAGMENT_SCHEMA)
    return watch.over(fragments, lost_lines=F.sum(F.when(F.col("role") == LOST, F.col("seq")))).where(F.col("role") != LOST)


def _with_owner(slim: DataFrame) -> DataFrame:
    """For every fragment the last start at or before it in its file; NULL before the first."""
    tail = F.when(F.col("role") == TAIL, F.struct("block", "seq", "wanted"))
    upto = Window.partitionBy("id_a", "id_b").orderBy("block", "seq")
    return slim.withColumn("owner", F.last(tail, ignorenulls=True).over(upto))


def unowned_lines(rims: DataFrame) -> int:
    """How many lines in HEAD fragments belong to no event, as they stand before the first one of a file that is read in several splits."""
    slim = rims.select("id_a", "id_b", "block", "seq", "role", "wanted", F.size("lines").alias("size"))
    lost = _with_owner(slim).where((F.col("role") == HEAD) & F.col("owner").isNull())
    return lost.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def stitch(rims: DataFrame) -> DataFrame:
    """Whole events from HEAD and TAIL fragments.

    Owners are found without any text, from at most two short rows per split; text is fetched for wanted ones only.
    """
    place = ["id_a", "id_b", "block", "seq"]
    slim = rims.select(*place, "role", "wanted")
    owners = _with_owner(slim).where("owner.wanted").select(*place, "owner")
    owned = rims.select(*place, "file_path", "lines").join(owners, place)
    piece = F.struct(F.col("block"), F.col("seq"), F.col("lines"))
    event = ["id_a", "id_b", F.col("owner.block").alias("block"), F.col("owner.seq").alias("seq")]
    return (
        owned.groupBy(*event)
        .agg(F.max("file_path").alias("file_path"), F.sort_array(F.collect_list(piece)).alias("pieces"))
        .select("file_path", "block", "seq", F.flatten(F.col("pieces.lines")).alias("lines"))
    )


def raw_text(lines: Column, encoding: str | Column | None = "auto") -> Column:
    """One string from the undecoded lines of an event: each decoded and cleaned, then joined by marks."""

    def one(line: Column) -> Column:
        return clean_line(line if encoding is None else decode_text(line, encoding))

    return F.array_join(F.transform(lines, one), NEWLINE_MARK)


def with_raw(df: DataFrame, keep: list[str], encoding: str | None = "auto", votes: DataFrame | None = None, only: Column | None = None) -> DataFrame:
    """`raw`, the text of each event, beside the columns to `keep`; decoded as `votes` say, if there are any, and `only` where it is wanted."""
    if votes is not None:
        df = with_votes(df, votes)
    raw = raw_text(F.col("lines"), encoding if votes is None else F.col("__cp1251"))
    return with_computed(df, "raw", raw if only is None else F.when(only, raw), keep)


def frame_events(
    lines: DataFrame,
    event_name: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    in_file_order: bool = False,
    encoding: str | None = "auto",
) -> DataFrame:
    """One row per wanted event: `file_path`, `block` and `seq` (its identity), `raw` (its text)."""
    whole = event_fragments(lines, event_name, start, end, in_file_order).where(F.col("role") == WHOLE)
    # files read as one split have no rims
    cut = lines.where(~F.col("sole")) if "sole" in lines.columns else lines
    rims = event_fragments(cut, event_name, start, end, in_file_order).where(F.col("role") != WHOLE)
    identity = ["file_path", "block", "seq"]

    votes = file_votes(lines) if encoding == BY_FILE else None

    def finish(df: DataFrame) -> DataFrame:
        return with_raw(df, identity, encoding, votes)

    return finish(whole).unionByName(finish(stitch(rims)))
