"""Continuous loading of arriving files, and user scripts over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stats import check_error_limit, check_tolerance
from ..operators.validate import REASON, check_rows, split_rejects
from ..schema import TargetColumn, names, target_of
from ..sources.delimited import BLOCK, SOURCE, skip_rows, split_lines
from ..session import pinned
from ..settings import LoadSetting


def stream_load(spark: SparkSession, folder: str, table: str, checkpoint: str,
                setting: LoadSetting = LoadSetting(), columns: Sequence[TargetColumn] | None = None,
                reject_path: str | None = None, files_per_batch: int | None = None,
                batch_column: str | None = "batch", available_now: bool = True) -> StreamingQuery:
    """Load text files as they arrive in ``folder``.

    ``batch_column`` is a partition column of the table that takes the batch id. A batch is classified once, into the shared
    folder, and counted by that write; a batch over its limits fails the stream before anything is loaded. Its valid rows
    then overwrite their own partition and its rejects ``<reject path>/batch=<id>``, so a replay leaves no copy. A table
    without such a column needs ``batch_column=None``, which appends, and a replay after a crash may then repeat a batch.
    Rejects go to ``reject_path`` or the setting's. Settings that make no sense for a stream are refused.
    """
    refused = [n for n in ("multi_line", "codec", "truncate", "check_first") if getattr(setting, n)]
    if refused:
        raise ValueError(f"stream_load reads lines and adds batches: no {', '.join(refused)}")
    found = target_of(spark.table(table))
    if batch_column and batch_column not in names(found):
        raise ValueError(f"{table} has no column {batch_column!r}; batch_column=None appends without it")
    cols = list(columns or [c for c in found if c.name != batch_column])
    rejected_to = reject_path or setting.reject_path
    reader = spark.readStream.schema("value string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(folder).select(
        "value", F.col("_metadata.file_path").alias(SOURCE), F.col("_metadata.file_block_start").alias(BLOCK))

    def body(batch: DataFrame, batch_id: int) -> None:
        rows = skip_rows(batch, setting.skip_rows).drop(SOURCE, BLOCK)
        counts = Observation()
        checked = pinned(check_rows(split_lines(rows, names(cols), setting), cols, setting.null_string, setting.repair_utf8).observe(
            counts, F.count(F.lit(1)).alias("total"), F.count(REASON).alias("rejected")), "stream-batch")
        check_error_limit(counts.get["rejected"], setting.error_limit)
        check_tolerance(counts.get["total"], counts.get["rejected"], setting.error_tolerance)
        valid, rejects = split_rejects(checked, cols)
        if rejected_to:
            rejects.select("_reject").write.mode("overwrite").text(f"{rejected_to}/batch={batch_id}")
        if batch_column:
            # A named partition is replaced on its own, whatever the session's overwrite mode.
            valid.createOrReplaceTempView("arrived_rows")
            checked.sparkSession.sql(
                f"INSERT OVERWRITE TABLE {table} PARTITION (`{batch_column}` = {batch_id}) SELECT * FROM arrived_rows")
        else:
            valid.write.insertInto(table)

    writer = lines.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def script_transform(df: DataFrame, command: str, output: str = "line string", view: str = "_script_input") -> DataFrame:
    """Pipe rows, tab-separated, through a script on the executors and read what it prints.

    Each task feeds its own copy of the script, so the script must treat rows on their own.
    """
    df.createOrReplaceTempView(view)
    cols = ", ".join(f"`{c}`" for c in df.columns)
    quoted = command.replace("\\", "\\\\").replace("'", "\\'")
    return df.sparkSession.sql(f"SELECT TRANSFORM ({cols}) USING '{quoted}' AS ({output}) FROM {view}")
