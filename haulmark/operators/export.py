"""Rows to delimited lines and files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..settings import REJECT_DELIMITER, REPLICATION_CAP, ExportSetting
from ..sources.files import CODECS
from ..sources.tables import split_by

# Codec names as the text writer knows them.
WRITER_CODECS = {"gzip": "gzip", "bzip2": "bzip2", "default": "deflate"}


def as_text(df: DataFrame, name: str) -> Column:
    """Text of a column; booleans, numbers, dates and timestamps as Spark casts them."""
    return F.col(f"`{name}`").cast("string")


def _quoted(text: Column, setting: ExportSetting) -> Column:
    q, e = setting.quotechar, setting.escapechar
    inner = text
    if e != q:
        inner = F.replace(inner, F.lit(e), F.lit(e + e))
    return F.concat(F.lit(q), F.replace(inner, F.lit(q), F.lit(e + q)), F.lit(q))


def line_of(df: DataFrame, setting: ExportSetting = ExportSetting(), columns: Sequence[str] | None = None) -> Column:
    """One output line: fields joined as they are, or with ``quoting`` each non-NULL field quoted
    and escaped. NULL is an empty field in both."""
    cells = []
    for name in columns or df.columns:
        text = as_text(df, name)
        cells.append(_quoted(text, setting) if setting.quoting else text)
    return F.array_join(F.array(*cells), setting.delimiter, "")


def header_line(columns: Sequence[str], setting: ExportSetting = ExportSetting()) -> str:
    if not setting.quoting:
        return setting.delimiter.join(columns)
    q, e = setting.quotechar, setting.escapechar
    return setting.delimiter.join(
        q + (c if e == q else c.replace(e, e + e)).replace(q, e + q) + q for c in columns)


def to_lines(df: DataFrame, setting: ExportSetting = ExportSetting()) -> DataFrame:
    """The data lines of an export as a one-column frame ``line``."""
    return df.select(line_of(df, setting).alias("line"))


def force_quoted_lines(df: DataFrame, setting: ExportSetting = ExportSetting()) -> DataFrame:
    """Lines of a bulk copy-out: every non-NULL field quoted, NULL empty and bare."""
    return to_lines(df, replace(setting, quoting=True))


def _write_lines(df: DataFrame, lines: DataFrame, path: str, setting: ExportSetting) -> int:
    """Write part files and return the rows written, counted by the write itself."""
    seen = Observation()
    out = lines.observe(seen, F.count(F.lit(1)).alias("rows"))
    options = dict(setting.options)
    if setting.codec:
        if setting.codec not in CODECS:
            raise ValueError(f"codec {setting.codec!r} is not one of {', '.join(CODECS)}")
        options["compression"] = WRITER_CODECS[setting.codec]
    if setting.replication:
        options["dfs.replication"] = str(min(setting.replication, REPLICATION_CAP))
    if setting.block_size:
        options["dfs.blocksize"] = str(setting.block_size)
    mode = "overwrite" if setting.overwrite else "errorifexists"
    if setting.header:
        # Every part file starts with the header: the first row of each task carries it in front.
        label = header_line(df.columns, setting)
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        out = out.select(F.when(first, F.concat(F.lit(label + "\n"), F.col("line"))).otherwise(F.col("line")).alias("line"))
    out.write.mode(mode).options(**options).text(path)
    rows = seen.get["rows"]
    if setting.header and rows == 0:
        df.sparkSession.range(1).select(F.lit(label).alias("line")).write.mode("overwrite").options(**options).text(path)
    return rows


def export_delimited(df: DataFrame, path: str, setting: ExportSetting = ExportSetting()) -> int:
    """Write rows as delimited part files and return how many rows were written."""
    return _write_lines(df, to_lines(df, setting), path, setting)


def export_to_fs(df: DataFrame, path: str, overwrite: bool = False, codec: str | None = None,
                 setting: ExportSetting = ExportSetting()) -> int:
    """As ``export_delimited`` with an overwrite flag and a codec (gzip, bzip2 or default)."""
    return export_delimited(df, path, replace(setting, overwrite=overwrite, codec=codec))


def export_force_quoted(df: DataFrame, path: str, setting: ExportSetting = ExportSetting()) -> int:
    return _write_lines(df, force_quoted_lines(df, setting), path, replace(setting, quoting=True))


def write_rejects(rejects: DataFrame, path: str, overwrite: bool = False) -> int:
    """Reject lines (column ``_reject``) as text: no header, no quotes, fields split by ``\\u0001``."""
    lines = rejects.select(F.col("_reject").alias("line"))
    return _write_lines(lines, lines, path, ExportSetting(delimiter=REJECT_DELIMITER, overwrite=overwrite))


def write_format(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists", **options: str) -> None:
    """Write text, csv, json, orc, parquet, avro or sequence files. Text takes a one-column frame."""
    if fmt == "sequence":
        pairs = df.select(F.lit("").alias("k"), line_of(df).alias("v")).rdd.map(lambda r: (r.k, r.v))
        pairs.saveAsSequenceFile(path)
        return
    try:
        df.write.mode(mode).format(fmt).options(**options).save(path)
    except Exception as error:
        if fmt == "avro":
            raise RuntimeError("avro needs the spark-avro package on the classpath") from error
        raise


def import_to(df: DataFrame, where: str, target_type: str = "path", truncate: bool = False,
              fmt: str = "parquet") -> int:
    """Store rows as files under a path or as a catalog table; ``truncate`` replaces what is there."""
    if target_type not in ("path", "table"):
        raise ValueError(f"target type {target_type!r} is not path or table")
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    mode = "overwrite" if truncate else "append"
    if target_type == "path":
        out.write.mode(mode).format(fmt).save(where)
    elif df.sparkSession.catalog.tableExists(where):
        out.write.insertInto(where, overwrite=truncate)
    else:
        out.write.mode(mode).format(fmt).saveAsTable(where)
    return seen.get["rows"]


def extract(source: DataFrame, where: str, target_type: str = "path", split: str | None = None,
            cols: Sequence[str] = (), n: int = 10, truncate: bool = False, fmt: str = "parquet") -> int:
    """Move a table or query result to a path or table in ``n`` parallel pieces; returns rows."""
    return import_to(split_by(source, split, cols, n) if split else source, where, target_type, truncate, fmt)
