"""Delimited text as string columns.

Lines are read as plain text and cut by JVM expressions, so a file is split across tasks, blank
lines stay visible (they are arity rejects), and dropping unused columns cannot hide a bad line.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..settings import LoadSetting
from .files import scan_compressed
from .quoted import quoted_records

LINE = "_line"
ARITY_OK = "_arity_ok"
SOURCE = "_source"
BLOCK = "_block"
SEQ = "_seq"

_REGEX_META = set(".$|()[{^?*+\\")


def literal_pattern(char: str) -> str:
    """A one-character regex; Spark's ``split`` has a fast path for exactly this form."""
    return "\\" + char if char in _REGEX_META else char


def scan_lines(spark: SparkSession, path: str | Sequence[str], setting: LoadSetting = LoadSetting(),
               positions: bool = False) -> DataFrame:
    """One row per line: ``value``, ``_source`` and, with ``positions``, ``_block`` and ``_seq``.

    ``path`` may be one path or many, each with ``* ? [ {`` globs; all files read as one input.
    ``(_source, _block, _seq)`` orders lines as they stand in their files.
    """
    if setting.codec:
        lines = scan_compressed(spark, path, setting.codec).withColumn(BLOCK, F.lit(0).cast("bigint"))
    else:
        lines = spark.read.text(path if isinstance(path, str) else list(path)).select(
            "value",
            F.col("_metadata.file_path").alias(SOURCE),
            F.col("_metadata.file_block_start").alias(BLOCK),
        )
    lines = skip_rows(lines, setting.skip_rows)
    if positions:
        return lines.withColumn(SEQ, F.monotonically_increasing_id())
    return lines.drop(BLOCK)


def skip_rows(lines: DataFrame, n: int) -> DataFrame:
    """Drop the first ``n`` lines of every file.

    A task reads a split front to back, so counting the lines seen of the split that starts at
    byte 0 is exact and needs no shuffle or sort. Arrow batches from later splits pass untouched.
    """
    if n <= 0:
        return lines

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, 0
        for batch in batches:
            source, block = batch.column(SOURCE), batch.column(BLOCK)
            heads = pc.equal(block, 0)
            if not pc.any(heads).as_py():
                yield batch
                continue
            runs = pc.run_end_encode(source)
            keep, start = [], 0
            for run, end in enumerate(runs.run_ends.to_pylist()):
                name = runs.values[run].as_py()
                if name != current:
                    current, seen = name, 0
                head_rows = pc.sum(heads.slice(start, end - start)).as_py() or 0
                dropped = min(max(n - seen, 0), head_rows)
                seen += head_rows
                if dropped < end - start:
                    keep.append(batch.slice(start + dropped, end - start - dropped))
                start = end
            yield from keep

    return lines.mapInArrow(drop, lines.schema)


def split_lines(lines: DataFrame, columns: Sequence[str], setting: LoadSetting = LoadSetting(),
                line: str = "value") -> DataFrame:
    """Cut ``line`` into string columns; other input columns are kept.

    Adds ``_line`` (the text as read) and ``_arity_ok`` (field count equals the column count).
    With quoting off the quote character is ordinary data.
    """
    kept = [F.col(c) for c in lines.columns if c != line]
    n = len(columns)
    if not setting.quoting:
        parts = lines.select(*kept, F.col(line).alias(LINE),
                             F.split(F.col(line), literal_pattern(setting.delimiter), -1).alias("_parts"))
        return parts.select(
            *[F.get("_parts", i).alias(c) for i, c in enumerate(columns)],
            *kept, LINE, (F.size("_parts") == n).alias(ARITY_OK),
        )
    fields = ", ".join([f"`f{i}` string" for i in range(n)] + ["`_bad` string"])
    options = {
        "sep": setting.delimiter, "quote": setting.quotechar, "escape": setting.escapechar,
        "columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1",
    }
    parts = lines.select(*kept, F.col(line).alias(LINE),
                         F.from_csv(F.col(line), F.lit(fields), options).alias("_row"))
    blank_short = (F.trim(LINE) == "") & F.lit(n > 1)
    return parts.select(
        *[F.col(f"_row.f{i}").alias(c) for i, c in enumerate(columns)],
        *kept, LINE, (F.col("_row._bad").isNull() & ~blank_short).alias(ARITY_OK),
    )


def scan_delimited(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str],
                   setting: LoadSetting = LoadSetting(), positions: bool = False) -> DataFrame:
    """Delimited files as string columns plus ``_line``, ``_arity_ok`` and ``_source``.

    ``multi_line`` reads quoted fields that hold line breaks, in any number of splits; there ``_line`` is the whole record.
    """
    if not setting.multi_line:
        return split_lines(scan_lines(spark, path, setting, positions), columns, setting)
    if setting.codec:
        raise ValueError("multi_line reads allow no explicit codec")
    records = quoted_records(spark, path, setting).select("value", F.col("source").alias(SOURCE), F.col("block").alias(BLOCK))
    out = split_lines(records, columns, setting)
    return out.withColumn(SEQ, F.monotonically_increasing_id()) if positions else out.drop(BLOCK)


def rendered(column: Column | str, as_type: str | None = None) -> Column:
    """Text of a value as exports write it; NULL stays NULL."""
    col = F.col(column) if isinstance(column, str) else column
    return (col.cast(as_type) if as_type else col).cast("string")
