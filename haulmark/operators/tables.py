"""Writing to and emptying catalog and JDBC tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..schema import TargetColumn, names, target_of
from ..session import pinned, scratch_path
from ..settings import BATCH_ROWS
from ..statements import name_parts
from .validate import check_rows, strict_rows


def insert_batch(df: DataFrame, table: str, batch_rows: int = BATCH_ROWS, url: str | None = None,
                 overwrite: bool = False, **options: str) -> int:
    """Append rows to a catalog table, or over JDBC in batches when a URL is given; returns rows."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if url:
        out.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch_rows, truncate=True, **options) \
            .mode("overwrite" if overwrite else "append").save()
    else:
        out.write.insertInto(table, overwrite=overwrite)
    return seen.get["rows"]


def load_strict(fields: DataFrame, table: str, columns: list[TargetColumn] | None = None,
                truncate: bool = False) -> int:
    """Load string columns with no tolerance: the first bad row fails the job and nothing is kept."""
    spark = fields.sparkSession
    rows = strict_rows(check_rows(fields, columns or target_of(spark.table(table))), columns or target_of(spark.table(table)))
    return insert_batch(rows, table, overwrite=truncate)


def load_rebuild(fields: DataFrame, table: str, columns: list[TargetColumn] | None = None) -> tuple[int, DataFrame]:
    """Drop the table's side tables, rebuild it empty and load what passes; returns rows and rejects."""
    spark = fields.sparkSession
    cols = columns or target_of(spark.table(table))
    for suffix in ("_et", "_uv", "_wt", "_lg"):
        spark.sql(f"DROP TABLE IF EXISTS {table}{suffix}")
    drop_recreate(spark, table)
    checked = check_rows(fields, cols)
    loaded = insert_batch(checked.where(F.col("_reason").isNull()).select(*names(cols)), table)
    return loaded, checked.where(F.col("_reason").isNotNull())


def truncate_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"TRUNCATE TABLE {table}")


def with_overwrite_mode(spark: SparkSession, mode: str) -> SparkSession:
    """A session on the same catalog with its own partition overwrite mode; the caller's settings stay."""
    other = spark.newSession()
    other.catalog.setCurrentDatabase(spark.catalog.currentDatabase())
    other.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    other.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return other


def _overwrite_with_nothing(spark: SparkSession, table: str) -> None:
    other = with_overwrite_mode(spark, "static")
    other.createDataFrame([], other.table(table).schema).write.insertInto(table, overwrite=True)
    spark.catalog.refreshTable(table)


def drop_recreate(spark: SparkSession, table: str) -> None:
    """Drop a table and create it again, empty, from its own definition.

    The rows go first: dropping an external table leaves its files, which the new table would show.
    """
    ddl = spark.sql(f"SHOW CREATE TABLE {table}").first()[0]
    _overwrite_with_nothing(spark, table)
    spark.sql(f"DROP TABLE {table}")
    spark.sql(ddl)


def truncate_else_recreate(spark: SparkSession, table: str) -> None:
    """Empty a table; where it refuses to be truncated (an external one does), drop and create it again."""
    try:
        truncate_table(spark, table)
    except Exception as error:
        if "TRUNCATE" not in str(error).upper():
            raise
        drop_recreate(spark, table)


def swap_recreate(spark: SparkSession, table: str) -> None:
    """Make a table an empty one of the same shape; its kind, location and properties stay."""
    _overwrite_with_nothing(spark, table)


_HIT, FOLDER = "_hit_by_predicate", "_file_folder"


def rows_after_delete(df: DataFrame, predicate: str) -> DataFrame:
    """Rows a DELETE leaves: those for which the predicate is false or NULL."""
    return df.where(~F.coalesce(F.expr(predicate), F.lit(False)))


def rows_after_update(df: DataFrame, assignments: dict[str, str], predicate: str) -> DataFrame:
    """Rows after an UPDATE: matching rows take the new values, computed from the old row."""
    return _updated(df, assignments, F.coalesce(F.expr(predicate), F.lit(False)))


def _updated(df: DataFrame, assignments: dict[str, str], hit: Column) -> DataFrame:
    types = dict(df.dtypes)
    return df.select(*[
        F.when(hit, F.expr(assignments[c]).cast(types[c])).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c)
        for c in df.columns])


def _literal(value) -> str:
    return "null" if value is None else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


# Up to so many touched partitions are broadcast to prune the rewrite; beyond it they are joined.
BROADCAST_PARTITIONS = 10_000


def _rewrite(spark: SparkSession, table: str, predicate: str, change, alias: str | None = None) -> int:
    """Put ``change(rows)`` in the place of the rows; returns how many met the predicate.

    The new rows are written to the shared folder first and then overwrite the table from there, so its kind,
    location and properties stay and no old row is left under its path. They are counted by that first write. If the
    overwrite fails half-way, the staged rows are still whole. A partitioned table rewrites only the partitions that hold
    a row that meets the predicate.
    """
    parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    columns = spark.table(table).columns
    rows, touched = spark.table(table), None
    if parts:
        alias = alias or name_parts(table)[-1]
        touched = pinned(_named(with_folder(rows), alias).where(F.expr(predicate)).select(*parts, FOLDER).distinct(), "touched")
        n = touched.count()
        if not n:
            return 0
        rows = in_partitions(rows, touched, parts, n <= BROADCAST_PARTITIONS)
    seen = Observation()
    hit = F.coalesce(F.expr(predicate), F.lit(False))
    marked = _named(rows, alias).withColumn(_HIT, hit).observe(seen, F.count_if(_HIT).alias("rows"))
    path = scratch_path(spark, "rewrite")
    staged = pinned(change(_named(marked, alias)).select(*columns), "rewrite", path)
    if not seen.get["rows"]:
        return 0
    put_back(spark, table, path, staged.schema, parts, touched)
    return seen.get["rows"]


def with_folder(rows: DataFrame) -> DataFrame:
    """Rows with the folder of their file, which for a partitioned table is their partition's."""
    return rows.select("*", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias(FOLDER))


def in_partitions(rows: DataFrame, touched: DataFrame, parts: list[str], few: bool) -> DataFrame:
    """The rows of the partitions that ``touched`` lists, which is broadcast if it is known to be ``few``."""
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in parts]
    return rows.alias("r").join((F.broadcast(touched) if few else touched).alias("t"), same, "left_semi")


def put_back(spark: SparkSession, table: str, path: str, schema: StructType, parts: list[str], touched: DataFrame | None, kept: str = "true") -> None:
    """Overwrite a table, or the partitions it was touched in, with the staged rows that are ``kept``; partitions left without rows go."""
    other = with_overwrite_mode(spark, "dynamic" if parts else "static")
    staged = other.read.schema(schema).parquet(path).where(kept).select(*spark.table(table).columns)
    staged.write.insertInto(table, overwrite=True)
    if parts:
        _empty_partitions(spark, table, parts, touched, spark.read.schema(schema).parquet(path).where(kept))
    spark.catalog.refreshTable(table)


def _named(df: DataFrame, alias: str | None) -> DataFrame:
    return df.alias(alias) if alias else df


def _empty_partitions(spark: SparkSession, table: str, parts: list[str], touched: DataFrame, staged: DataFrame) -> None:
    """Partitions that lost all their rows: their names go in one statement, then the folders that an external table keeps."""
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"l.{c}")) for c in parts]
    emptied = touched.alias("t").join(staged.select(*parts).distinct().alias("l"), same, "left_anti").collect()
    if not emptied:
        return
    specs = {", ".join(f"`{c}` = {_literal(row[c])}" for c in parts): None for row in emptied}
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS " + ", ".join(f"PARTITION ({s})" for s in specs))
    for folder in {row[FOLDER] for row in emptied}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def delete_where(spark: SparkSession, table: str, predicate: str, alias: str | None = None) -> int:
    """Delete matching rows by rewriting what is left; returns rows deleted."""
    return _rewrite(spark, table, predicate, lambda rows: rows.where(f"not {_HIT}"), alias)


def update_where(spark: SparkSession, table: str, assignments: dict[str, str], predicate: str = "true",
                 alias: str | None = None) -> int:
    """Update matching rows by rewriting the table; returns rows updated.

    A partition column cannot be assigned, since only the affected partitions are rewritten.
    """
    parts = {c.name for c in spark.catalog.listColumns(table) if c.isPartition}
    if parts & set(assignments):
        raise ValueError("a partition column cannot be updated")
    return _rewrite(spark, table, predicate, lambda rows: _updated(rows, assignments, F.col(_HIT)), alias)
