"""Job-log analytics over a log table ``(job_id, line_no, line)``.

Each operator is one scan with a pre-aggregated group by; "the last line wins" is a ``max_by``, so a
job with very many lines is combined where it is read. Patterns cover the whole line unless said.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from .stats import with_bulk_totals, with_stream_totals

# The line patterns of the job logs.
ROWS_LOADED = r"^(\d+) Rows loaded to (\w+)$"
TABLE_STATS = r"^Table\s(\b.+\b)\s.+numRows=(\d+),.*$"
PARTITION_STATS = r"^.*(Partition|Table)[\s]+([^\{]+)(\{.*\})?[\s]+stats:[\s]+\[numFiles=\d+, numRows=(\d+), .*\]$"
MAP_INPUT = r"^.*map[\s]+input[\s]+records=(\d+)$"
MAP_OUTPUT = r"^.*map[\s]+output[\s]+records=(\d+)$"
MAP_OUTPUT_ALONE = r"^[\s]*Map output records=(\d+)[\s]*$"
JOB_ID = r"^.*Job id is (\b[\w]*.?[\w]+-[\d]+\b),.*$"
JOB_LOG = r"^Job log:[\s]+(.+)$"
ROWS_SENT = r"^tpt_writer: Total Rows Sent To RDBMS:[\s]+(\d+)$"
ROWS_APPLIED = r"^tpt_writer: Total Rows Applied:[\s]+(\d+)$"
ROWS_ERR1 = r"^tpt_writer: Total Rows in Error Table 1:[\s]+(\d+)$"
ROWS_ERR2 = r"^tpt_writer: Total Rows in Error Table 2:[\s]+(\d+)$"
ROWS_DUPLICATE = r"^tpt_writer: Total Duplicate Rows:[\s]+(\d+)$"
BULK_ERROR_FILE = r"^tpt_reader:.+\b(\d+)\b.*error rows sent to error file.*$"
STREAM_ERROR_FILE = r"^tpt_reader:\s\b[\w]+\b\s(\d+)\serror rows sent to error file.+$"
ROWS_INSERTED = r"^tpt_writer: Rows Inserted:\s+(\d+)$"
HEX_LINE = r"[0-9]{5}\s+((?:[0-9A-Fa-f]{2}\s?)+)"


def _number(line: Column, pattern: str, group: int = 1) -> Column:
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group).cast("bigint"))


def _text(line: Column, pattern: str, group: int = 1) -> Column:
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group))


def _last(value: Column) -> Column:
    """The value of the last line that has one."""
    return F.max_by(value, F.when(value.isNotNull(), F.col("line_no")))


def hive_rows_by_table(lines: DataFrame) -> DataFrame:
    """Rows loaded per table, summed over both message forms."""
    line = F.col("line")
    found = lines.select(
        F.coalesce(_text(line, ROWS_LOADED, 2), _text(line, TABLE_STATS, 1)).alias("table_name"),
        F.coalesce(_number(line, ROWS_LOADED, 1), _number(line, TABLE_STATS, 2)).alias("_n"))
    return found.where("table_name is not null").groupBy("table_name").agg(F.sum("_n").alias("rows"))


def hive_partition_rows(lines: DataFrame) -> DataFrame:
    """Rows per table from table and partition statistics; the partition part is left out of the name."""
    line = F.col("line")
    found = lines.where(line.rlike(PARTITION_STATS)).select(
        F.rtrim(F.regexp_extract(line, PARTITION_STATS, 2)).alias("table_name"),
        F.regexp_extract(line, PARTITION_STATS, 4).cast("bigint").alias("_n"))
    return found.groupBy("table_name").agg(F.sum("_n").alias("rows"))


def mr_counters(lines: DataFrame) -> DataFrame:
    """Map input and output records per job, in any case; 0 when the log names none."""
    line = F.lower(F.trim("line"))
    return lines.groupBy("job_id").agg(
        F.coalesce(_last(_number(line, MAP_INPUT)), F.lit(0)).alias("input_records"),
        F.coalesce(_last(_number(line, MAP_OUTPUT)), F.lit(0)).alias("output_records"))


def map_output_rows(lines: DataFrame) -> DataFrame:
    """Map output records per job from lines that hold nothing else."""
    return lines.groupBy("job_id").agg(
        F.coalesce(_last(_number(F.col("line"), MAP_OUTPUT_ALONE)), F.lit(0)).alias("rows_loaded"))


def bulk_load_counters(lines: DataFrame) -> DataFrame:
    """Bulk loader counters per log: sent, loaded, both error tables, duplicates and error-file rows."""
    line = F.col("line")
    counters = {"sent": ROWS_SENT, "loaded": ROWS_APPLIED, "err_table1": ROWS_ERR1, "err_table2": ROWS_ERR2,
                "duplicate": ROWS_DUPLICATE}
    aggs = [F.coalesce(_last(_number(line, p)), F.lit(0)).alias(n) for n, p in counters.items()]
    aggs.append(F.coalesce(_last(_number(line, BULK_ERROR_FILE)), F.lit(0)).alias("err_file"))
    aggs += [_last(_text(line, JOB_ID)).alias("job_name"), _last(_text(line, JOB_LOG)).alias("log_file")]
    return with_bulk_totals(lines.groupBy("job_id").agg(*aggs))


def stream_load_counters(lines: DataFrame, error_table: DataFrame | None = None) -> DataFrame:
    """Stream loader counters per log; ``error_table(job_id, error_table)`` adds counted error rows."""
    line = F.col("line")
    base = lines.groupBy("job_id").agg(
        F.coalesce(_last(_number(line, ROWS_INSERTED)), F.lit(0)).alias("loaded"),
        F.coalesce(_last(_number(line, STREAM_ERROR_FILE)), F.lit(0)).alias("error_file"),
        _last(_text(line, JOB_ID)).alias("job_name"), _last(_text(line, JOB_LOG)).alias("log_file"))
    if error_table is None:
        base = base.withColumn("error_table", F.lit(0).cast("bigint"))
    else:
        base = base.join(error_table, "job_id", "left").withColumn("error_table", F.coalesce("error_table", F.lit(0)))
    return with_stream_totals(base)


def fastload_error_records(messages: DataFrame, table_name: str) -> DataFrame:
    """Records of multi-line error messages (column ``message``) about ``table_name``.

    ``kind`` is ``ET`` with ``field``, ``code`` and the data parcel decoded from its hex dump, or ``UV``
    with the message's tail lines joined by a comma. Other messages drop out.
    """
    parts = F.split("message", r"\r?\n", -1)
    out = messages.withColumn("_m", parts)
    head = F.get("_m", 0)
    kind = F.when(head.contains(f"{table_name}_ERR_1"), F.lit("ET")).when(
        head.contains(f"{table_name}_ERR_2"), F.lit("UV"))

    def piece(i: int, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(F.coalesce(F.get("_m", i), F.lit("")), pattern, 1), F.lit(""))

    size = F.coalesce(piece(3, r"ActualDataParcelLength=(\d+)").try_cast("int"), F.lit(-1))
    digits = F.substring(F.replace(F.coalesce(piece(5, HEX_LINE), F.lit("")), F.lit(" "), F.lit("")), 1, 1 << 30)
    parcel = F.when((size > 0) & (F.length(digits) >= size * 2),
                    F.decode(F.unhex(F.left(digits, size * 2)), "ISO-8859-1"))
    et = F.col("kind") == "ET"
    return out.withColumn("kind", kind).where("kind is not null").select(
        *[c for c in messages.columns if c != "message"], "kind",
        F.when(et, F.coalesce(piece(2, "ErrorFieldName=(.+)"), F.lit(""))).alias("field"),
        F.when(et, F.coalesce(piece(1, r"ErrorCode=(.+)").try_cast("int"), F.lit(-1))).alias("code"),
        F.when(et, F.coalesce(parcel, F.lit(""))).otherwise(
            F.array_join(F.slice("_m", F.lit(2), F.greatest(F.size("_m") - 1, F.lit(0))), ",")).alias("record"))


def _nth_lines(lines: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """Lines at 1-based positions of each job as columns.

    A filter on ``row_number`` is pushed below the shuffle as a per-task limit for each job, so a job
    with very many lines sends only its first few.
    """
    position = F.row_number().over(Window.partitionBy("job_id").orderBy("line_no"))
    heads = lines.select("job_id", "line", position.alias("_pos")).where(F.col("_pos") <= max(wanted.values()))
    return heads.groupBy("job_id").agg(*[
        F.max(F.when(F.col("_pos") == n, F.col("line"))).alias(name) for name, n in wanted.items()])


def _zip_map(names: Column, values: Column) -> Column:
    """Names to values as far as both go."""
    n = F.least(F.size(names), F.size(values))
    return F.map_from_arrays(F.slice(names, F.lit(1), n), F.slice(values, F.lit(1), n))


def tsv_first_row(lines: DataFrame) -> DataFrame:
    """Header line and first data line of tab-separated output, as a map per job."""
    pairs = _nth_lines(lines, {"_header": 1, "_row": 2})
    return pairs.select("job_id", _zip_map(F.split("_header", "\t", -1), F.split("_row", "\t", -1)).alias("values"))


def boxed_table_first_row(lines: DataFrame) -> DataFrame:
    """Header and first row of a table drawn with ``+--+`` rules and pipes, as a map per job.

    Of the non-empty lines the second is the header and the fourth the row. Blank cells drop out.
    """
    pairs = _nth_lines(lines.where(F.length("line") > 0), {"_header": 2, "_row": 4})

    def cells(c: str) -> Column:
        trimmed = F.transform(F.split(c, "\\|", -1), lambda x: F.trim(x))
        return F.filter(trimmed, lambda x: x != "")

    return pairs.select("job_id", _zip_map(cells("_header"), cells("_row")).alias("values"))


def running_jobs(lines: DataFrame, job_name: str) -> DataFrame:
    """Status lines that mention ``<job name>-<digits>`` anywhere; lines are trimmed."""
    name = re.escape(job_name)
    return lines.select("job_id", "line_no", F.trim("line").alias("line")).where(F.col("line").rlike(f"{name}-[0-9]+"))
