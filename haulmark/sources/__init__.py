"""Reading: delimited text, files, catalog tables and JDBC."""

from .delimited import scan_delimited, scan_lines, skip_rows, split_lines
from .files import (expand_globs, merge_files, path_stats, scan_compressed, scan_format,
                    scan_sequencefile)
from .jdbc import jdbc_scan, jdbc_scan_partitioned, jdbc_scan_where, jdbc_url
from .tables import column_catalog, parse_table_name, scan_table, split_by, table_metadata

__all__ = [
    "scan_delimited", "scan_lines", "skip_rows", "split_lines", "expand_globs", "merge_files", "path_stats",
    "scan_compressed", "scan_format", "scan_sequencefile", "jdbc_scan", "jdbc_scan_partitioned",
    "jdbc_scan_where", "jdbc_url", "column_catalog", "parse_table_name", "scan_table", "split_by",
    "table_metadata",
]
