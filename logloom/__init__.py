"""Reports over application trace logs, as Spark jobs."""

from logloom.functions.text import last_line, normalize_sql
from logloom.functions.times import floor_time, nearest_time
from logloom.operators.aggregates import Measure, aggregate
from logloom.operators.filters import Filter, keep_rows, load_filters
from logloom.operators.formulas import add_formulas, formula_column
from logloom.operators.percentiles import exact_percentiles
from logloom.operators.states import States, finished, merged, states_of
from logloom.plans.report import report, report_lines, reports_together, run_report, run_reports, skipped
from logloom.plans.spec import ReportSpec, SpecError, parse_spec
from logloom.plans.store import ReportStore
from logloom.sinks import read_table, write_report, write_reports, write_table
from logloom.sources.events import EventColumns, extract_properties, log_events, parse_events
from logloom.sources.files import file_inventory, list_log_files, list_skipped_files, select_log_files, skipped_files
from logloom.sources.framing import frame_events
from logloom.sources.lines import decode_lines, read_lines
from logloom.sources.watch import Watch

__all__ = [
    "EventColumns", "Filter", "Measure", "ReportSpec", "ReportStore", "SpecError", "States", "Watch", "add_formulas", "aggregate",
    "decode_lines", "exact_percentiles", "extract_properties", "file_inventory", "finished", "floor_time",
    "formula_column", "frame_events", "keep_rows", "last_line", "list_log_files", "list_skipped_files", "load_filters",
    "log_events", "merged", "nearest_time", "normalize_sql", "parse_events", "parse_spec", "read_lines", "read_table", "report",
    "report_lines", "reports_together", "run_report", "run_reports", "select_log_files", "skipped", "skipped_files", "states_of",
    "write_report", "write_reports", "write_table",
]
