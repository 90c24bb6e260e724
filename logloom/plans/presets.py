"""Ready-made report specifications. Directories, period and output are filled in by the caller."""

from __future__ import annotations

from typing import Any


def _spec(event_name: str, keys: list[dict[str, Any]], group: str, sort: str, limit: int, **more: Any) -> dict[str, Any]:
    return {
        "logger_directory": "", "logger_file": "", "output_directory": "", "output_file": "report",
        "base_directories": [], "base_subdirectories": [], "start_period": "", "end_period": "",
        "cpu_usage_percent": 0, "keys_filters": [], "event_name": event_name, "event_limit": limit,
        "keys_result": keys, "keys_aggregate": group, "keys_sort": sort, **more,
    }


_COUNT = {"name": "count", "alias": "Count", "aggregation": ["sum"]}


def top_calls(limit: int = 50) -> dict[str, Any]:
    """Longest server calls by context: totals, shares, spread and duration histogram."""
    spread = ["sum", "percent", "mean", "median", "p95", "stddev", "min", "max", "intervals_3_5"]
    keys = [
        {"name": "Context", "alias": "Context"},
        {"name": "duration", "alias": "Duration, s", "aggregation": spread},
        _COUNT,
    ]
    return _spec("CALL", keys, "Context", "duration desc, Context asc", limit)


def duration_by_context(event_name: str = "CALL", limit: int = 0) -> dict[str, Any]:
    """Total duration by the last line of the execution context."""
    keys = [
        {"name": "lastcontext", "alias": "Context line"},
        {"name": "duration", "alias": "Duration, s", "aggregation": ["sum", "percent"]},
        _COUNT,
        {"name": "each", "alias": "Per call, s", "formula": "duration / count"},
    ]
    return _spec(event_name, keys, "lastcontext", "duration desc, lastcontext asc", limit)


def memory_by_user(limit: int = 20) -> dict[str, Any]:
    """Users whose calls took the most memory."""
    keys = [
        {"name": "Usr", "alias": "User"},
        {"name": "Memory", "alias": "Memory, bytes", "aggregation": ["sum", "max", "mean"]},
        _COUNT,
    ]
    return _spec("CALL", keys, "Usr", "Memory desc, Usr asc", limit)


def slow_sql(event_name: str = "DBMSSQL", limit: int = 50) -> dict[str, Any]:
    """Database queries by total time, literals replaced so that equal statements meet."""
    keys = [
        {"name": "Sql", "alias": "Query"},
        {"name": "duration", "alias": "Duration, s", "aggregation": ["sum", "max", "p95", "percent"]},
        _COUNT,
    ]
    return _spec(event_name, keys, "Sql", "duration desc, Sql asc", limit)


def locks(event_name: str = "TTIMEOUT", limit: int = 0) -> dict[str, Any]:
    """Lock timeouts or deadlocks one by one, with the process and file they were logged in."""
    keys = [
        {"name": "timestamp", "alias": "Time"},
        {"name": "processname", "alias": "Process"},
        {"name": "filename", "alias": "File"},
        {"name": "Usr", "alias": "User"},
        {"name": "Context", "alias": "Context"},
        {"name": "duration", "alias": "Duration, s"},
    ]
    return _spec(event_name, keys, "", "timestamp asc", limit)


def time_series(event_name: str = "CALL", bucket: str = "5m") -> dict[str, Any]:
    """Events and mean duration per time bucket."""
    keys = [
        {"name": "timestamp", "alias": "Time", "aggregation": [f"roundtime_{bucket}"]},
        _COUNT,
        {"name": "duration", "alias": "Duration, s", "aggregation": ["mean"]},
    ]
    return _spec(event_name, keys, "timestamp", "timestamp asc", 0)


def over(preset: dict[str, Any], **values: Any) -> dict[str, Any]:
    """A preset with directories, period, output or other keys set."""
    return {**preset, **values}
