"""Readers and writers of project tables, coding sheets, raw tables and transcripts."""

from weftline.sources.projects import replace_coder, scan_project, sink_tables
from weftline.sources.sheets import scan_sheets, sheet_columns
from weftline.sources.raw import scan_tables_dir, scan_transcripts

__all__ = [
    "scan_project", "replace_coder", "sink_tables", "scan_sheets", "sheet_columns", "scan_tables_dir", "scan_transcripts",
]
