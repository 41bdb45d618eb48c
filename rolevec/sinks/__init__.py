"""Writers and text renderings."""

from rolevec.sinks.registry import read_entries, read_runs, record_run
from rolevec.sinks.text import (
    format_assignments,
    format_dense,
    format_kept,
    format_unaligned,
    report_lines,
    sweep_lines,
    with_run_id,
    write_lines,
    write_table,
)

__all__ = [
    "format_assignments",
    "format_dense",
    "format_kept",
    "format_unaligned",
    "read_entries",
    "read_runs",
    "record_run",
    "report_lines",
    "sweep_lines",
    "with_run_id",
    "write_lines",
    "write_table",
]
