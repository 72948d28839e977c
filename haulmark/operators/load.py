"""The composed load: scan, classify, write, count, gate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..schema import TargetColumn, names, target_of
from ..session import pinned
from ..settings import LoadSetting
from ..sources.delimited import scan_delimited
from ..sources.files import path_stats
from .export import write_rejects
from .stats import auto_mode, check_error_limit, check_tolerance
from .tables import insert_batch
from .validate import REASON, REJECT, check_rows, split_rejects, strict_rows

_VALID = "_valid"


@dataclass(frozen=True)
class LoadResult:
    total: int
    loaded: int
    rejected: int
    mode: str = "default"


def checked_rows(spark: SparkSession, path: str | Sequence[str], columns: Sequence[TargetColumn],
                 setting: LoadSetting = LoadSetting(), positions: bool = False) -> DataFrame:
    """Scan and classify: the narrow front half of every load."""
    fields = scan_delimited(spark, path, names(columns), setting, positions)
    return check_rows(fields, columns, setting.null_string, setting.repair_utf8)


def skip_if_empty(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """True when the source has no bytes."""
    return path_stats(spark, path).first()["bytes"] == 0


def load(spark: SparkSession, path: str | Sequence[str], table: str, setting: LoadSetting = LoadSetting(),
         columns: Sequence[TargetColumn] | None = None, url: str | None = None, **jdbc: str) -> LoadResult:
    """Load delimited files into a catalog table (or a JDBC table when ``url`` is given).

    The source is read and classified once. Without a reject file or a limit the rows go straight to the table, counted by
    that write. Otherwise the classified rows are written to the shared folder by outcome, in the same single pass; then
    rejects are written, the limits are judged, and only if they hold are the valid rows inserted from there. So a refused load
    leaves the target as it was, its rejects can be looked at, and a source that changes meanwhile makes no difference.
    """
    cols = list(columns or target_of(spark.table(table)))
    mode, batch_rows = setting.mode, setting.rows_per_batch
    if mode == "auto":
        mode, batch_rows = auto_mode(path_stats(spark, path).first()["bytes"], mode, batch_rows, setting.bulk_threshold)
    checked = checked_rows(spark, path, cols, setting)
    counts = Observation()
    watched = checked.observe(counts, F.count(F.lit(1)).alias("total"), F.count(REASON).alias("rejected"))
    if not setting.reject_path and setting.error_limit is None and setting.error_tolerance is None:
        insert_batch(split_rejects(watched, cols)[0], table, batch_rows, url, setting.truncate, **jdbc)
        return LoadResult(counts.get["total"], counts.get["total"] - counts.get["rejected"], counts.get["rejected"], mode)
    by_outcome = pinned(watched.withColumn(_VALID, F.col(REASON).isNull()), "load", partition_by=[_VALID])
    total, rejected = counts.get["total"], counts.get["rejected"]
    if setting.reject_path:
        rejects = by_outcome.where(f"not {_VALID}") if rejected else spark.createDataFrame([], f"{REJECT} string")
        write_rejects(rejects, setting.reject_path, overwrite=True)
    check_error_limit(rejected, setting.error_limit)
    check_tolerance(total, rejected, setting.error_tolerance)
    insert_batch(by_outcome.where(_VALID).select(*names(cols)), table, batch_rows, url, setting.truncate, **jdbc)
    return LoadResult(total, total - rejected, rejected, mode)


def bulk_load(spark: SparkSession, path: str | Sequence[str], table: str, setting: LoadSetting = LoadSetting(),
              columns: Sequence[TargetColumn] | None = None) -> int:
    """A load without a reject path: the first bad row fails the job; returns rows."""
    cols = list(columns or target_of(spark.table(table)))
    rows = strict_rows(checked_rows(spark, path, cols, setting), cols)
    return insert_batch(rows, table, setting.rows_per_batch, overwrite=setting.truncate)
