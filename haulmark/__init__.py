"""Move and check data with Spark: load, validate, export, reconcile."""

from .operators.export import export_delimited, export_force_quoted, export_to_fs, extract, import_to, write_format
from .operators.load import LoadResult, bulk_load, load
from .operators.validate import check_rows, split_rejects
from .plans.sqlapi import sql_execute, sql_export, sql_from_file, sql_read, sql_script
from .schema import TargetColumn, target, target_of
from .session import build_session
from .settings import ExportSetting, LoadSetting

__all__ = [
    "ExportSetting", "LoadResult", "LoadSetting", "TargetColumn", "build_session", "bulk_load", "check_rows",
    "export_delimited", "export_force_quoted", "export_to_fs", "extract", "import_to", "load", "split_rejects",
    "sql_execute", "sql_export", "sql_from_file", "sql_read", "sql_script", "target", "target_of", "write_format",
]
