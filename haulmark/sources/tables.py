"""Catalog tables: scan, split, column metadata and table names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SPLITS = ("hash", "partition", "amp")


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """A ``[db.]table`` from the catalog."""
    return spark.table(name)


def split_by(df: DataFrame, how: str, cols: Sequence[str] = (), n: int = 10) -> DataFrame:
    """Spread rows over ``n`` partitions; the rows themselves do not change.

    ``hash`` groups equal keys but is a rebalance, so AQE splits a partition that one key fills.
    ``partition`` ranges over the keys; the trailing task id breaks a hot key over several ranges.
    ``amp`` spreads evenly.
    """
    if how not in SPLITS:
        raise ValueError(f"split {how!r} is not one of {', '.join(SPLITS)}")
    if how == "amp":
        return df.repartition(n)
    if not cols:
        raise ValueError(f"split {how!r} needs columns")
    if how == "hash":
        return df.hint("rebalance", n, *cols)
    return df.repartitionByRange(n, *[F.col(c) for c in cols], F.spark_partition_id())


def table_metadata(spark: SparkSession, name: str) -> DataFrame:
    """Column names and types of a table, from the catalog and without a scan."""
    return spark.sql(f"DESCRIBE TABLE {name}").where(~F.col("col_name").startswith("#") & (F.col("col_name") != "")) \
        .select(F.col("col_name").alias("name"), F.col("data_type").alias("type")).dropDuplicates(["name"])


# Bytes a column of a catalog type code takes in a delimited record.
BYTES_DATE = 15
BYTES_TIMESTAMP = 35
BYTES_NUMBER = 25
DECIMAL_EXTRA = 5
ALIAS_CHARS = 23
TIMESTAMP_CODES = ("TS", "TZ")
NUMBER_CODES = ("I ", "I2", "I1", "I8", "F")


def byte_length(kind: Column, digits: Column, length: Column) -> Column:
    return (
        F.when(kind == "DA", F.lit(BYTES_DATE))
        .when(kind == "D", digits + DECIMAL_EXTRA)
        .when(kind.isin(*TIMESTAMP_CODES), F.lit(BYTES_TIMESTAMP))
        .when(kind.isin(*NUMBER_CODES), F.lit(BYTES_NUMBER))
        .otherwise(length)
    )


def column_catalog(catalog: DataFrame, database: str | None = None, table: str | None = None) -> DataFrame:
    """Load columns of the tables in a column catalog, numbered by column id within each table.

    Input columns: ``databasename, tablename, columnid, columnname, columntype, decimaltotaldigits,
    columnlength, nullable``. A group here is the column list of one table, which databases bound.
    """
    rows = catalog
    if database is not None:
        rows = rows.where(F.col("databasename") == database)
    if table is not None:
        rows = rows.where(F.col("tablename") == table)
    position = F.row_number().over(Window.partitionBy("databasename", "tablename").orderBy("columnid"))
    name = F.trim("columnname")
    return rows.select(
        "databasename", "tablename", "columnid", name.alias("name"), F.col("columntype").alias("type"),
        byte_length(F.col("columntype"), F.col("decimaltotaldigits"), F.col("columnlength")).alias("bytes"),
        F.concat(F.substring(name, 1, ALIAS_CHARS), F.lit("_"), position.cast("string"), F.lit("_")).alias("alias"),
        "nullable",
    )


def parse_table_name(col: Column | str) -> Column:
    """``db.table`` or ``table`` as a struct of ``db`` (NULL when absent) and ``table``."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.split(c, "\\.", -1)
    db = F.when(F.size(parts) == 2, F.get(parts, 0)).when(F.size(parts) > 2, F.raise_error(
        F.concat(F.lit("not a table name: "), c)))
    return F.struct(db.alias("db"), F.element_at(parts, -1).alias("table"))
