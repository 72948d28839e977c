"""Tables and queries over JDBC, serial or in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# URL forms by database kind.
URL_FORMS = {
    "mysql": "jdbc:mysql://{host}:{port}/{database}?zeroDateTimeBehavior=convertToNull",
    "postgres": "jdbc:postgresql://{host}:{port}/{database}",
    "teradata": "jdbc:teradata://{host}:{port}/{database}",
}


def jdbc_url(kind: str, host: str, port: int, database: str) -> str:
    if kind not in URL_FORMS:
        raise ValueError(f"database kind {kind!r} is not one of {', '.join(URL_FORMS)}")
    return URL_FORMS[kind].format(host=host, port=port, database=database)


def _one_source(query: str | None, table: str | None) -> None:
    if not query and not table:
        raise ValueError("give either a query or a table")


def jdbc_scan(spark: SparkSession, url: str, query: str | None = None, table: str | None = None,
              **options: str) -> DataFrame:
    """A query or a table; the query wins when both are given. Filters and columns are pushed down."""
    _one_source(query, table)
    source = {"query": query} if query else {"dbtable": table}
    return spark.read.format("jdbc").options(url=url, **source, **options).load()


def jdbc_scan_where(spark: SparkSession, url: str, table: str | None = None, where: str | None = None,
                    query: str | None = None, **options: str) -> DataFrame:
    """A table with a where clause, which the source evaluates; with ``query`` the clause is ignored."""
    rows = jdbc_scan(spark, url, query, table, **options)
    return rows.where(where) if where and not query else rows


def jdbc_scan_partitioned(spark: SparkSession, url: str, query: str | None = None, table: str | None = None,
                          split_by: str | None = None, num_mappers: int = 1, **options: str) -> DataFrame:
    """Read in ``num_mappers`` ranges of ``split_by``; the bounds come from a one-row min/max query.

    A free-form query needs ``split_by``. NULL keys go to the first range, so no row is lost.
    """
    _one_source(query, table)
    if query and not split_by:
        raise ValueError("a free-form query needs split_by")
    source = f"({query}) q" if query else table
    reader = spark.read.format("jdbc").options(url=url, dbtable=source, **options)
    if not split_by or num_mappers <= 1:
        return reader.load()
    bounds = reader.load().agg(F.min(split_by).alias("low"), F.max(split_by).alias("high")).first()
    if bounds.low is None:
        return reader.load()
    return reader.options(partitionColumn=split_by, lowerBound=str(bounds.low), upperBound=str(bounds.high),
                          numPartitions=num_mappers).load()
