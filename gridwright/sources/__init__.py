"""Readers, writers and versioned tables."""

from .files import infer_and_cast, read_csv, read_json, write_table, write_tables
from .versions import read_version, versions, write_version
from .workbooks import read_workbooks

__all__ = ["infer_and_cast", "read_csv", "read_json", "read_version", "read_workbooks", "versions", "write_table", "write_tables", "write_version"]
