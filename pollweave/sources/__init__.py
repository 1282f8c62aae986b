"""Readers, writers and page extraction."""

from .pages import PollColumns, clean_poll_rows, link_rows, table_rows
from .tables import (
    read_lines,
    read_statistics,
    read_table,
    read_two_row_header,
    read_wave,
    save_csv,
    save_table,
)

__all__ = [
    "PollColumns",
    "clean_poll_rows",
    "link_rows",
    "read_lines",
    "read_statistics",
    "read_table",
    "read_two_row_header",
    "read_wave",
    "save_csv",
    "save_table",
    "table_rows",
]
