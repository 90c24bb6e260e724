"""Time functions: hour-stamped file names, event time, bucketing. All results are TIMESTAMP_NTZ."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket units and their length in seconds.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def parse_bucket(text: str) -> int:
    """`5m` -> bucket length in microseconds."""
    found = re.fullmatch(r"(\d+)([smhd])", text or "", flags=re.ASCII)
    if not found or int(found[1]) < 1:
        raise ValueError(f"bad time bucket {text!r}: use a positive number and s, m, h or d, e.g. 5m")
    return int(found[1]) * UNIT_SECONDS[found[2]] * 1_000_000


def parse_period(text: str) -> datetime:
    """`YYMMDDhhmmss` -> datetime; two-digit years are 2000 to 2099."""
    try:
        if not re.fullmatch(r"\d{12}", str(text), flags=re.ASCII):
            raise ValueError("twelve digits expected")
        return datetime.strptime(f"20{text}", "%Y%m%d%H%M%S")
    except ValueError as error:
        raise ValueError(f"bad period bound {text!r}, use YYMMDDhhmmss: {error}") from error


def ntz(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def _clock(stamp: Column, minute: Column, second: Column) -> Column:
    def two(at: int) -> Column:
        return F.substring(stamp, at, 2).try_cast("int")

    return F.try_make_timestamp_ntz(two(1) + 2000, two(3), two(5), two(7), minute, second)


def file_hour(file_name: Column) -> Column:
    """The hour a log file covers, from its `YYMMDDhh` prefix; NULL if the name has none."""
    stamp = F.substring(file_name, 1, 8)
    return F.when(stamp.rlike("^[0-9]{8}$"), _clock(stamp, F.lit(0), F.lit(0)))


def event_time(file_name: Column, line: Column) -> Column:
    """Whole-second time of an event: hour from the file name, `mm:ss` from the start of its line."""
    minute = F.substring(line, 1, 2).try_cast("int")
    second = F.substring(line, 4, 2).try_cast("int")
    return _clock(F.substring(file_name, 1, 8), minute, second)


def _micros(c: Column) -> Column:
    """Microseconds since 1970-01-01 on the same clock; unlike timestamp_diff, free of any time zone."""
    seconds = F.unix_date(c.cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    fraction = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return seconds * 1_000_000 + fraction


def _bucketed(c: Column, bucket: str, shift: bool) -> Column:
    size = parse_bucket(bucket)
    epoch = ntz(datetime(1970, 1, 1))
    micros = _micros(c.cast("timestamp_ntz"))
    if shift:
        micros = micros + F.lit(size // 2)
    whole = micros - F.pmod(micros, F.lit(size))
    return F.timestamp_add("MICROSECOND", whole, epoch)


def floor_time(c: Column, bucket: str) -> Column:
    """Start of the epoch-aligned bucket that holds the time."""
    return _bucketed(c, bucket, shift=False)


def nearest_time(c: Column, bucket: str) -> Column:
    """The bucket border nearest to the time, halves going up."""
    return _bucketed(c, bucket, shift=True)
