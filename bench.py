"""Headline queries, timed; prints one JSON line.

The events of `$BENCH_SF_DIR` are first written out as hourly log files (not timed), which the log reports
then read as files; and once more as a few large files, many times over. Table queries read the given Parquet. Every query runs once to warm up and then
twice; the faster run counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TABLE_QUERIES = (
    "flt_all", "flt_regex", "agg_multi", "agg_percent", "agg_intervals", "agg_p95_fine_groups", "agg_roundtime_floor",
    "srt_top_n", "txt_normalize_sql", "rep_formula",
)


def write_logs(spark, root: str) -> int:
    """The events table as log files; returns their size in bytes."""
    from logloom.rendered import render

    lines = render(spark.read.parquet(f"{SF_DIR}/events.parquet"), f"{root}/full").orderBy("file_path", "pos")
    size, path, out = 0, None, None
    for row in lines.select("file_path", "value").toLocalIterator(prefetchPartitions=True):
        if row.file_path != path:
            path = row.file_path
            os.makedirs(os.path.dirname(path), exist_ok=True)
            out and out.close()
            out = open(path, "w", encoding="utf-8", newline="")
        size += out.write(row.value + "\r\n")
    out and out.close()
    return size


# Large logs: how many, and how often they hold all events.
LARGE_FILES, TIMES = 8, 12


def write_large_logs(logs: str, root: str) -> int:
    """All log files put together into a few; returns their size in bytes."""
    folder = f"{root}/full/rphost_1"
    os.makedirs(folder)
    files = sorted(os.path.join(top, name) for top, _, names in os.walk(logs) for name in names if name.endswith(".log"))
    for n in range(LARGE_FILES):
        content = b"".join(open(f, "rb").read() for f in files[n::LARGE_FILES])
        with open(f"{folder}/240101{10 + n}.log", "wb") as out:
            for _ in range(TIMES):
                out.write(content)
    return sum(os.path.getsize(f"{folder}/{name}") for name in os.listdir(folder))


def main() -> None:
    from pyspark.sql import SparkSession

    from checks import QUERIES
    from logloom.plans import presets
    from logloom.plans.report import run_report, run_reports
    from logloom.sources.files import file_inventory, list_log_files

    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{scratch}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    logs = f"{scratch}/logs"
    megabytes = write_logs(spark, logs) / 1048576
    large_megabytes = write_large_logs(logs, f"{scratch}/large") / 1048576

    def over_files(preset, event_name, folder=logs):
        return presets.over(
            preset, event_name=event_name, base_directories=[folder], base_subdirectories=["full"],
            start_period="240101000000", end_period="240131235959",
        )

    log_reports = {
        "log_top_calls": over_files(presets.top_calls(), "CLICK"),
        "log_duration_by_context": over_files(presets.duration_by_context(), "VIEW"),
        "log_memory_by_user": over_files(presets.memory_by_user(), "PURCHASE"),
        "log_slow_sql": over_files(presets.slow_sql(), "ERROR"),
        "log_listing": over_files(presets.locks(limit=1000), "SIGNUP"),
        "log_time_series": over_files(presets.time_series(), "VIEW"),
    }
    runs = {"log_inventory": lambda: file_inventory(list_log_files(spark, [logs], ["full"]))}
    runs.update({name: (lambda s=spec: run_report(spark, s)) for name, spec in log_reports.items()})
    runs["log_six_together"] = lambda: run_reports(spark, list(log_reports.values()))
    large = over_files(presets.memory_by_user(), "PURCHASE", f"{scratch}/large")
    runs["log_large_files"] = lambda: run_report(spark, large)
    runs.update({name: (lambda q=QUERIES[name]: q(spark, SF_DIR)) for name in TABLE_QUERIES})

    seconds = {}
    for name, make in runs.items():
        timed = []
        for _ in range(3):
            began = time.perf_counter()
            made = make()
            for report in made if isinstance(made, list) else [made]:
                report.write.format("noop").mode("overwrite").save()
            timed.append(time.perf_counter() - began)
        seconds[name] = round(min(timed[1:]), 3)
    spark.stop()

    log_seconds = [seconds[name] for name in log_reports]
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS), "log_mb": round(megabytes, 2),
        "log_mb_per_sec": round(megabytes * len(log_seconds) / sum(log_seconds), 2),
        "large_log_mb": round(large_megabytes, 2), "large_log_mb_per_sec": round(large_megabytes / seconds["log_large_files"], 2),
    }))


if __name__ == "__main__":
    main()
