"""Registered queries over the given tables, each with the SQL that gives the same rows."""

from checks import log_queries, report_queries, table_queries  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
