"""SQL entry points: read one row, export a query, run statements, scripts and files."""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.text import PLACEHOLDER, resolve_variables
from ..operators.export import export_delimited
from ..operators.merge import merge_into
from ..operators.tables import delete_where, update_where
from ..settings import ExportSetting
from ..statements import Create, Delete, Insert, Merge, Update, cut, key_name, name_parts

STATEMENT_END = ";\n"
FILE_PROVIDERS = ("parquet", "orc", "csv", "json", "text", "avro")


def first_row(df: DataFrame) -> dict[str, Any]:
    """The first row by name; no row is an empty dict. Booleans become yes/no and dates text."""
    rows = df.limit(1).collect()
    if not rows:
        return {}
    return {k: _scalar(k, v) for k, v in rows[0].asDict().items()}


def _scalar(name: str, value: Any) -> Any:
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if value is None or isinstance(value, (str, int, float)) or type(value).__name__ == "Decimal":
        return value
    raise TypeError(f"column {name}: values of type {type(value).__name__} are not supported here")


def sql_read(spark: SparkSession, sql: str) -> dict[str, Any]:
    """First row of a query, fetched with a limit."""
    return first_row(spark.sql(sql))


def row_pairs(df: DataFrame) -> DataFrame:
    """The first row as ``(name, value)`` text rows, staying on the cluster."""
    def text(name: str, kind: str):
        c = F.col(f"`{name}`")
        shown = F.when(c, F.lit("yes")).when(~c, F.lit("no")) if kind == "boolean" else c.cast("string")
        return F.struct(F.lit(name).alias("name"), shown.alias("value"))

    return df.limit(1).select(F.inline(F.array(*[text(n, k) for n, k in df.dtypes])))


def sql_export(spark: SparkSession, sql: str, path: str, setting: ExportSetting = ExportSetting()) -> int:
    """Write a query's rows as delimited files; returns rows."""
    return export_delimited(spark.sql(sql), path, setting)


def _shown(spark: SparkSession, table: str) -> str:
    """A table's name as results give it: without the session catalog and the current database."""
    parts = [p.lower() for p in name_parts(table)]
    for known in ("spark_catalog", spark.catalog.currentDatabase().lower()):
        if len(parts) > 1 and parts[0] == known:
            parts = parts[1:]
    return ".".join(parts)


def _counted(spark: SparkSession, head: str, query: str) -> int:
    """Run ``head`` followed by ``query``; returns the rows that the query gave while it was written."""
    rows = spark.sql(query)
    if len({c.lower() for c in rows.columns}) < len(rows.columns):
        rows = rows.toDF(*[f"_c{i}" for i in range(len(rows.columns))])  # by place; a name that is there twice means nothing
    seen, view = Observation(), f"_counted_{uuid.uuid4().hex}"
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).createOrReplaceTempView(view)
    try:
        spark.sql(f"{head} SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)
    return seen.get["rows"]


def _insert(spark: SparkSession, part: Insert) -> tuple[str, int]:
    shown = part.target if part.folder else _shown(spark, part.target)
    if part.guard and not spark.sql(f"SHOW PARTITIONS {part.target} {part.guard}").isEmpty():
        return shown, 0  # IF NOT EXISTS, and it does
    return shown, _counted(spark, part.head, part.query)


def _run(spark: SparkSession, sql: str) -> tuple[list[tuple[str, int]], int]:
    """Run one statement; returns the inserts by target, and all rows effected.

    The statement is cut at the words of its outermost level and the parts are parsed by Spark. INSERT and CREATE TABLE AS count
    their query's rows while these are written; DELETE, UPDATE and MERGE of tables that the engine cannot change row by
    row rewrite the table. What cannot be cut without doubt is an error, and nothing is run.
    """
    part = cut(sql)
    if isinstance(part, (Delete, Update, Merge)) and not _row_level(spark, part.target.name):
        table, alias = part.target.name, part.target.alias and key_name(part.target.alias)
        if isinstance(part, Delete):
            return [], delete_where(spark, table, part.condition, alias)
        if isinstance(part, Update):
            return [], update_where(spark, table, part.values, part.condition, alias)
        source = spark.sql(f"SELECT * FROM {part.source} AS _given")
        named = part.source_alias or (None if part.source.startswith("(") else part.source)
        return [], merge_into(spark, table, source, part.on, part.clauses, alias, key_name(named) if named else "source")
    inserts: list[tuple[str, int]] = []
    if isinstance(part, list):
        inserts = [_insert(spark, x) for x in part]
    elif isinstance(part, Create) and not (part.if_new and spark.catalog.tableExists(part.target)):
        inserts = [(_shown(spark, part.target), _counted(spark, part.head, part.query))]
    else:
        return [], _affected(spark.sql(sql))
    return inserts, sum(n for _, n in inserts)


def _row_level(spark: SparkSession, table: str) -> bool:
    """Whether the table's provider takes DELETE and UPDATE itself; plain file tables do not."""
    found = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    return found.get("Provider", "").lower() not in FILE_PROVIDERS


def _affected(result: DataFrame) -> int:
    """Rows a statement reports; 0 for DDL, which reports none."""
    if "num_affected_rows" in result.columns:
        return result.first()["num_affected_rows"]
    return 0


def sql_execute(spark: SparkSession, sql: str) -> int:
    """Run one DDL or DML statement, DELETE, UPDATE and MERGE included; returns rows effected."""
    return _run(spark, sql)[1]


def statements_of(text: str) -> list[str]:
    """A script cut at ``;`` line ends, blanks dropped."""
    return [s.strip().rstrip(";") for s in text.split(STATEMENT_END) if s.strip()]


def sql_script(spark: SparkSession, script: str | Sequence[str]) -> dict[str, int]:
    """Run statements in order; returns rows inserted, summed by target table."""
    rows: dict[str, int] = {}
    for sql in statements_of(script) if isinstance(script, str) else script:
        for table, n in _run(spark, sql)[0]:
            rows[table] = rows.get(table, 0) + n
    return rows


def render_text(text: str, variables: Mapping[str, str]) -> str:
    """Fill the placeholders of a statement; a missing required name is an error."""
    return resolve_variables({**variables, "\0text": text})["\0text"]


def sql_text(spark: SparkSession, sql: str | None = None, path: str | None = None,
             variables: Mapping[str, str] | None = None) -> str:
    """A statement given inline or as a file, with its placeholders filled."""
    if sql is None and path is None:
        raise ValueError("give sql or the path of a sql file")
    text = sql if sql is not None else spark.read.text(path, wholetext=True).first()["value"]
    return render_text(text, variables or {}) if re.search(PLACEHOLDER, text) else text


def sql_from_file(spark: SparkSession, sql: str | None = None, path: str | None = None,
                  variables: Mapping[str, str] | None = None, args: Mapping[str, Any] | None = None) -> DataFrame:
    """The query of an inline text or a file. ``args`` binds ``:name`` markers without text splicing."""
    return spark.sql(sql_text(spark, sql, path, variables), args=dict(args) if args else None)
