"""Scan, export, validation and load queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import export as X, load as L, stats as S, tables as T, validate as V
from ..schema import names, target
from ..session import scratch_path
from ..settings import REJECT_DELIMITER, ExportSetting, LoadSetting
from ..sources import delimited as D, files as FS, tables as ST
from .inputs import (BAD_KEY, BLANK_QUANTITY, LINEITEM, LINEITEM_NAMES, ORDERS, REASONED_SQL, SHORT_LINE,
                     WIDE_FLAG, lineitem_export, lineitem_lines, lineitem_text, orders_export)
from .registry import query, table

PIPE = LoadSetting(delimiter="|")

ORDERS_TEXT_SQL = """select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus,
  cast(cast(o_totalprice as decimal(12,2)) as varchar) as o_totalprice, cast(cast(o_orderdate as date) as varchar) as o_orderdate,
  o_orderpriority from orders"""
ORDERS_TYPED_SQL = """select o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice as decimal(12,2)) as o_totalprice,
  cast(cast(o_orderdate as date) as varchar) as o_orderdate, o_orderpriority from orders"""
LINE_SQL = """concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as decimal(12,2)),
  cast(l_extendedprice as decimal(12,2)), cast(l_discount as decimal(4,2)), cast(l_tax as decimal(4,2)),
  l_returnflag, l_linestatus, cast(l_shipdate as date))"""


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    return V.check_rows(D.split_lines(lineitem_lines(spark, sf), LINEITEM_NAMES, PIPE), LINEITEM)


def _exported_orders(spark: SparkSession, sf: str, setting: ExportSetting) -> str:
    path = scratch_path(spark, "orders")
    X.export_delimited(orders_export(spark, sf), path, setting)
    return path


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


# --- scans -----------------------------------------------------------------------------------------

@query("scan_delimited", ORDERS_TEXT_SQL)
def scan_delimited(spark, sf):
    path = _exported_orders(spark, sf, ExportSetting(quoting=True))
    return D.scan_delimited(spark, path, names(ORDERS), LoadSetting(quoting=True)).select(*names(ORDERS))


@query("skip_rows", ORDERS_TEXT_SQL)
def skip_rows(spark, sf):
    path = _exported_orders(spark, sf, ExportSetting(delimiter="\t", header=True))
    return D.scan_delimited(spark, path, names(ORDERS), LoadSetting(delimiter="\t", header=True)).select(*names(ORDERS))


@query("merge_files", "select o_orderpriority, count(*) as n from orders group by 1")
def merge_files(spark, sf):
    path = scratch_path(spark, "merge")
    orders = table(spark, sf, "orders").select("o_orderpriority", F.col("o_orderpriority").alias("value"))
    orders.write.partitionBy("o_orderpriority").text(path)
    parts = [r["path"] for r in FS.expand_globs(spark, path, recursive=True).select(
        F.regexp_replace("path", "/[^/]+$", "").alias("path")).distinct().collect()]
    return FS.merge_files(spark, parts).groupBy(F.col("value").alias("o_orderpriority")).agg(F.count(F.lit(1)).alias("n"))


@query("path_stats", """select cast(sum(strlen(url) + 1) as bigint) as bytes from pages""")
def path_stats(spark, sf):
    path = scratch_path(spark, "urls")
    table(spark, sf, "pages").select("url").write.text(path)
    return FS.path_stats(spark, path).select("bytes")


@query("expand_globs", "select o_orderstatus, cast(sum(strlen(cast(o_orderkey as varchar)) + 1) as bigint) as bytes from orders group by 1")
def expand_globs(spark, sf):
    path = scratch_path(spark, "globs")
    table(spark, sf, "orders").select("o_orderstatus", F.col("o_orderkey").cast("string").alias("value")) \
        .write.partitionBy("o_orderstatus").text(path)
    files = FS.expand_globs(spark, f"{path}/o_orderstatus=[A-Z]/*.txt")
    status = F.regexp_extract("path", "o_orderstatus=([A-Z])/", 1)
    return files.groupBy(status.alias("o_orderstatus")).agg(F.sum("bytes").alias("bytes"))


@query("scan_compressed", "select url from pages")
def scan_compressed(spark, sf):
    path = scratch_path(spark, "bz2")
    table(spark, sf, "pages").select("url").write.option("compression", "bzip2").text(path)
    return FS.scan_compressed(spark, path, "bzip2").select(F.col("value").alias("url"))


@query("scan_sequencefile", f"select {LINE_SQL.replace('|', ',')} as line from lineitem")
def scan_sequencefile(spark, sf):
    path = scratch_path(spark, "seq")
    X.write_format(lineitem_export(spark, sf), path, "sequence")
    return FS.scan_sequencefile(spark, path).select(F.col("value").alias("line"))


@query("scan_format", ORDERS_TYPED_SQL)
def scan_format(spark, sf):
    path = scratch_path(spark, "orc")
    X.write_format(orders_export(spark, sf), path, "orc")
    return _dates_as_text(FS.scan_format(spark, path, "orc"))


@query("scan_table", "select n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey group by 1")
def scan_table(spark, sf):
    customers = _new_table(spark, "customers", "c_custkey bigint, c_nationkey bigint")
    T.insert_batch(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), customers)
    table(spark, sf, "nation").createOrReplaceTempView("scan_nation")
    joined = ST.scan_table(spark, customers).join(ST.scan_table(spark, "scan_nation"), F.expr("c_nationkey = n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))


@query("scan_where", "select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F' and o_custkey > 70")
def scan_where(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'F' and o_custkey > 70").select("o_orderkey", "o_orderpriority")


@query("table_metadata", """
  select * from (values ('c_custkey', 'bigint', 1), ('c_name', 'string', 2), ('customers', cast((select count(*) from customer) as varchar), 3)) as t(name, detail, place)""")
def table_metadata(spark, sf):
    name = _new_table(spark, "described", "c_custkey bigint, c_name string")
    T.insert_batch(table(spark, sf, "customer").select("c_custkey", "c_name"), name)
    rows = spark.table(name).agg(F.count(F.lit(1)).cast("string").alias("detail")).select(
        F.lit("customers").alias("name"), "detail", F.lit(3).alias("place"))
    listed = ST.table_metadata(spark, name)
    columns = listed.where("name in ('c_custkey', 'c_name')").select(
        "name", F.col("type").alias("detail"), F.when(F.col("name") == "c_custkey", 1).otherwise(2).alias("place"))
    return columns.unionByName(rows)


_SPLIT_SQL = "select c_mktsegment, count(*) as n, cast(sum(c_custkey) as bigint) as keys from customer group by 1"


def _split(spark, sf, how):
    rows = ST.split_by(table(spark, sf, "customer"), how, ["c_nationkey"], 8)
    return rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


@query("split_by_hash", _SPLIT_SQL)
def split_by_hash(spark, sf):
    return _split(spark, sf, "hash")


@query("split_by_partition", _SPLIT_SQL)
def split_by_partition(spark, sf):
    return _split(spark, sf, "partition")


@query("split_by_amp", _SPLIT_SQL)
def split_by_amp(spark, sf):
    return _split(spark, sf, "amp")


_TYPE_CODE = "case l_linenumber when 1 then 'DA' when 2 then 'D' when 3 then 'TS' when 4 then 'I8' when 5 then 'CV' else 'BV' end"
_CATALOG_SQL = f"""
  select l_returnflag as databasename, concat('t', cast(l_orderkey as varchar)) as tablename, l_linenumber as columnid,
    min(concat(' column_with_a_long_name_', cast(l_linenumber as varchar), ' ')) as columnname, min({_TYPE_CODE}) as columntype,
    cast(max(l_quantity) as int) as decimaltotaldigits, cast(max(l_suppkey) as int) as columnlength,
    case when max(l_discount) > 0.05 then 'Y' else 'N' end as nullable
  from lineitem group by l_returnflag, l_orderkey, l_linenumber"""


@query("column_catalog", f"""
  select databasename, tablename, columnid, trim(columnname) as name, columntype as type,
    case columntype when 'DA' then 15 when 'D' then decimaltotaldigits + 5 when 'TS' then 35 when 'I8' then 25 else columnlength end as bytes,
    concat(substr(trim(columnname), 1, 23), '_', cast(row_number() over (partition by databasename, tablename order by columnid) as varchar), '_') as alias,
    nullable
  from ({_CATALOG_SQL})""")
def column_catalog(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("databasename"), F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("tablename"),
        F.col("l_linenumber").alias("columnid")).agg(
        F.min(F.expr("concat(' column_with_a_long_name_', cast(l_linenumber as string), ' ')")).alias("columnname"),
        F.min(F.expr(_TYPE_CODE)).alias("columntype"), F.max("l_quantity").cast("int").alias("decimaltotaldigits"),
        F.max("l_suppkey").cast("int").alias("columnlength"),
        F.when(F.max("l_discount") > 0.05, "Y").otherwise("N").alias("nullable"))
    return ST.column_catalog(rows)


@query("parse_table_name", """
  select p_partkey, case when p_size % 2 = 0 then p_type end as db, p_brand as tbl from part""")
def parse_table_name(spark, sf):
    named = table(spark, sf, "part").selectExpr(
        "p_partkey", "case when p_size % 2 = 0 then concat(p_type, '.', p_brand) else p_brand end as name")
    parsed = named.select("p_partkey", ST.parse_table_name("name").alias("t"))
    return parsed.select("p_partkey", F.col("t.db").alias("db"), F.col("t.table").alias("tbl"))


# --- exports ---------------------------------------------------------------------------------------

@query("export_delimited", f"select {LINE_SQL} as line from lineitem")
def export_delimited(spark, sf):
    return X.to_lines(lineitem_export(spark, sf), ExportSetting(delimiter="|"))


_ODD_TEXT = "concat(p_name, ' \"', p_brand, '\" \\\\ x')"
_ODD_TEXT_SQL = "concat(p_name, ' \"', p_brand, '\" \\ x')"


@query("export_quoted", f"""
  select concat('"', cast(p_partkey as varchar), '",', case when p_size % 5 = 0 then '' else
    concat('"', replace(replace({_ODD_TEXT_SQL}, '\\', '\\\\'), '"', '\\"'), '"') end) as line from part""")
def export_quoted(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", f"case when p_size % 5 = 0 then null else {_ODD_TEXT} end as odd")
    return X.to_lines(rows, ExportSetting(quoting=True))


@query("export_force_quoted", f"""
  select concat('"', cast(p_partkey as varchar), '";', case when p_size % 5 = 0 then '' else
    concat('"', replace({_ODD_TEXT_SQL}, '"', '""'), '"') end) as line from part""")
def export_force_quoted(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", f"case when p_size % 5 = 0 then null else {_ODD_TEXT} end as odd")
    return X.force_quoted_lines(rows, ExportSetting(delimiter=";", escapechar='"'))


@query("export_to_fs", f"select {LINE_SQL} as line from lineitem")
def export_to_fs(spark, sf):
    path = scratch_path(spark, "export")
    X.export_to_fs(lineitem_export(spark, sf), path, overwrite=True, codec="gzip", setting=ExportSetting(delimiter="|"))
    return FS.scan_compressed(spark, path).select(F.col("value").alias("line"))


def _new_table(spark: SparkSession, label: str, ddl: str, partition: str | None = None) -> str:
    """A table of this run, its files in the shared folder."""
    path = scratch_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet " + (f"PARTITIONED BY ({partition}) " if partition else "") + f"LOCATION '{path}'")
    return name


ORDERS_DDL = ("o_orderkey bigint, o_custkey bigint, o_orderstatus varchar(1), o_totalprice decimal(12,2), "
              "o_orderdate date, o_orderpriority string")


@query("insert_batch", ORDERS_TYPED_SQL)
def insert_batch(spark, sf):
    name = _new_table(spark, "insert", ORDERS_DDL)
    T.insert_batch(orders_export(spark, sf), name)
    return _dates_as_text(spark.table(name))


@query("import_to", ORDERS_TYPED_SQL)
def import_to(spark, sf):
    path = scratch_path(spark, "import")
    X.import_to(orders_export(spark, sf), path)
    X.import_to(orders_export(spark, sf), path, truncate=True)
    return _dates_as_text(spark.read.parquet(path))


@query("extract", "select o_orderkey, o_custkey from orders where o_orderstatus = 'O'")
def extract(spark, sf):
    path = scratch_path(spark, "extract")
    rows = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    X.extract(rows, path, split="hash", cols=["o_custkey"], n=8, fmt="orc")
    return spark.read.orc(path)


@query("write_format", ORDERS_TYPED_SQL)
def write_format(spark, sf):
    path = scratch_path(spark, "parquet")
    X.write_format(orders_export(spark, sf), path, "parquet", compression="zstd")
    return _dates_as_text(FS.scan_format(spark, path, "parquet"))


@query("load_strict", ORDERS_TYPED_SQL)
def load_strict(spark, sf):
    name = _new_table(spark, "strict", ORDERS_DDL)
    text = orders_export(spark, sf)
    T.load_strict(text.select(*[F.col(c).cast("string").alias(c) for c in text.columns]), name, ORDERS)
    return _dates_as_text(spark.table(name))


@query("load_rebuild", f"select count(*) as n, cast(sum(l_partkey) as bigint) as parts from ({REASONED_SQL}) where reason is null")
def load_rebuild(spark, sf):
    ddl = ", ".join(f"{c.name} {c.type}" for c in LINEITEM)
    name = _new_table(spark, "rebuild", ddl)
    T.load_rebuild(D.split_lines(lineitem_lines(spark, sf), LINEITEM_NAMES, PIPE), name, LINEITEM)
    return spark.table(name).agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


@query("truncate_table", "select c_mktsegment, count(*) as n from customer where c_acctbal > 0 group by 1")
def truncate_table(spark, sf):
    name = _new_table(spark, "truncate", "c_custkey bigint, c_mktsegment string, c_acctbal double")
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    T.insert_batch(rows, name)
    T.truncate_else_recreate(spark, name)
    T.insert_batch(rows.where("c_acctbal > 0"), name)
    return spark.table(name).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("swap_recreate", "select c_mktsegment, count(*) as n from customer where c_acctbal <= 0 group by 1")
def swap_recreate(spark, sf):
    name = _new_table(spark, "swap", "c_custkey bigint, c_mktsegment string, c_acctbal double")
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    T.insert_batch(rows, name)
    T.swap_recreate(spark, name)
    T.insert_batch(rows.where("c_acctbal <= 0"), name)
    return spark.table(name).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


# --- validation ------------------------------------------------------------------------------------

@query("cast_typed", """
  select l_orderkey as k, l_linenumber as n, case when l_linenumber = 2 then null else l_partkey end as whole,
    cast(case when l_linenumber = 3 then null else cast(l_extendedprice as decimal(12,2)) end as decimal(12,2)) as price,
    l_linenumber = 4 as flag, case when l_linenumber = 5 then null else cast(cast(l_shipdate as date) as varchar) end as day,
    case when l_linenumber = 6 then null else strftime(l_shipdate, '%Y-%m-%d 10:05:00') end as moment,
    case when l_linenumber = 7 then null else '09:05:07' end as clock,
    concat_ws(',', case when l_linenumber = 2 then 'whole' end, case when l_linenumber = 3 then 'price' end,
      case when l_linenumber = 5 then 'day' end, case when l_linenumber = 6 then 'moment' end,
      case when l_linenumber = 7 then 'clock' end) as failed
  from lineitem""")
def cast_typed(spark, sf):
    cols = target(("whole", "bigint"), ("price", "decimal(12,2)"), ("flag", "boolean"), ("day", "date"),
                  ("moment", "timestamp_ntz"), ("clock", "time"))
    text = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as k", "l_linenumber as n",
        "case when l_linenumber = 2 then concat(' ', cast(l_partkey as string)) else concat('+', cast(l_partkey as string)) end as whole",
        "case when l_linenumber = 3 then '12,5' else cast(cast(l_extendedprice as decimal(12,2)) as string) end as price",
        "case when l_linenumber = 4 then 'TRUE' else 'yes' end as flag",
        "case when l_linenumber = 5 then date_format(l_shipdate, 'yyyy/MM/dd') else date_format(l_shipdate, 'yyyy-M-d') end as day",
        "case when l_linenumber = 6 then date_format(l_shipdate, 'yyyy-MM-dd') else date_format(l_shipdate, \"yyyy-MM-dd '10:5:00'\") end as moment",
        "case when l_linenumber = 7 then '24:00:00' else '9:5:7' end as clock")
    out = V.cast_typed(text, cols)
    return out.select("k", "n", "whole", "price", "flag", F.col("day").cast("string").alias("day"),
                      F.col("moment").cast("string").alias("moment"), "clock", F.array_join("_failed", ",").alias("failed"))


@query("blank_to_null", """
  select count(*) as total, count(case when l_partkey % 53 <> 0 then 1 end) as quantities from lineitem""")
def blank_to_null(spark, sf):
    rows = V.blank_to_null(lineitem_text(spark, sf).select("l_quantity"))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count("l_quantity").alias("quantities"))


@query("arity_check", f"select not ({SHORT_LINE}) as ok, count(*) as n from lineitem group by 1")
def arity_check(spark, sf):
    cut = lineitem_lines(spark, sf).select(F.split("value", "\\|", -1).alias("parts"))
    return cut.groupBy(V.arity_check(F.col("parts"), len(LINEITEM)).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query("split_rejects", f"""
  select coalesce(reason, 'loaded') as outcome, count(*) as n,
    cast(sum(case when reason is null and not ({BLANK_QUANTITY}) then cast(l_quantity as decimal(12,2)) end) as double) as quantity
  from ({REASONED_SQL}) group by 1""")
def split_rejects(spark, sf):
    counted = S.load_outcomes(_checked(spark, sf), "l_quantity")
    return counted.select("outcome", "n", F.col("l_quantity").cast("double").alias("quantity"))


@query("scan_quoted", "select cast(doc_id as varchar) as doc_id, source, sha256(coalesce(text, '')) as text_sha256 from documents")
def scan_quoted(spark, sf):
    """Texts with line breaks and quotes, written as quoted fields and read back by any number of tasks."""
    path = scratch_path(spark, "quoted")
    cell = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r'(["\\\\])', r"\\$1"), F.lit('"'))
    table(spark, sf, "documents").select(F.concat_ws(",", cell("doc_id"), cell("source"), cell("text")).alias("value")).write.text(path)
    cells = D.scan_delimited(spark, path, ["doc_id", "source", "text"], LoadSetting(quoting=True, multi_line=True))
    return cells.where("_arity_ok").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query("valid_rows", f"""
  select l_orderkey, l_partkey, l_linenumber, case when {BLANK_QUANTITY} then null else l_quantity end as l_quantity, l_returnflag,
    cast(cast(l_shipdate as date) as varchar) as l_shipdate from ({REASONED_SQL}) where reason is null""")
def valid_rows(spark, sf):
    valid, _ = V.split_rejects(_checked(spark, sf), LINEITEM)
    return valid.select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"),
                        "l_returnflag", F.col("l_shipdate").cast("string").alias("l_shipdate"))


@query("rejected_rows", f"""
  select reason, concat_ws('|', concat(cast(l_orderkey as varchar), case when {BAD_KEY} then 'x' else '' end), l_partkey, l_suppkey, l_linenumber,
    case when {BLANK_QUANTITY} then '' else cast(cast(l_quantity as decimal(12,2)) as varchar) end,
    cast(l_extendedprice as decimal(12,2)), cast(l_discount as decimal(4,2)), cast(l_tax as decimal(4,2)),
    concat(l_returnflag, case when {WIDE_FLAG} then '+' else '' end), l_linestatus, case when reason <> 'arity' then cast(l_shipdate as date) end) as line
  from ({REASONED_SQL}) where reason is not null""")
def rejected_rows(spark, sf):
    _, rejects = V.split_rejects(_checked(spark, sf), LINEITEM)
    return rejects.select(F.col("_reason").alias("reason"), F.translate("_reject", REJECT_DELIMITER, "|").alias("line"))


@query("write_rejects", f"""
  select concat_ws(chr(1), concat(cast(l_orderkey as varchar), case when {BAD_KEY} then 'x' else '' end), l_partkey, l_suppkey,
    l_linenumber, case when {BLANK_QUANTITY} then '' else cast(cast(l_quantity as decimal(12,2)) as varchar) end,
    cast(l_extendedprice as decimal(12,2)), cast(l_discount as decimal(4,2)), cast(l_tax as decimal(4,2)),
    concat(l_returnflag, case when {WIDE_FLAG} then '+' else '' end), l_linestatus, case when reason <> 'arity' then cast(l_shipdate as date) end) as line
  from ({REASONED_SQL}) where reason is not null""")
def write_rejects(spark, sf):
    path = scratch_path(spark, "rejects")
    # A row of the wrong arity is kept as its line, so its fields are still split by the file's delimiter.
    X.write_rejects(_checked(spark, sf).where("_reason is not null"), path)
    return spark.read.text(path).select(F.translate("value", "|", REJECT_DELIMITER).alias("line"))


@query("length_check", f"""
  select l_orderkey, l_linenumber, case when {WIDE_FLAG} then 'l_returnflag' else '' end as too_long from lineitem""")
def length_check(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"concat(l_returnflag, case when {WIDE_FLAG} then '+' else '' end) as l_returnflag", "l_linestatus")
    return V.length_check(rows, LINEITEM[8:10]).select("l_orderkey", "l_linenumber", F.array_join("_too_long", ",").alias("too_long"))


@query("load_stats", f"""
  select count(*) as total, count(case when reason is null then 1 end) as loaded, count(reason) as rejected from ({REASONED_SQL})""")
def load_stats(spark, sf):
    return S.load_stats(_checked(spark, sf))


@query("error_tolerance", f"""
  select count(*) as total, count(case when reason is null then 1 end) as loaded, count(reason) as rejected,
    count(reason) / cast(count(*) as double) as ratio, count(reason) / cast(count(*) as double) < 0.05 as passed from ({REASONED_SQL})""")
def error_tolerance(spark, sf):
    return S.error_tolerance(S.load_stats(_checked(spark, sf)), 0.05)


@query("error_limit", f"select count(*) > 2000 as over_limit from ({REASONED_SQL}) where reason is not null")
def error_limit(spark, sf):
    return S.error_limit(_checked(spark, sf).where("_reason is not null"))


_DISPOSITION_STREAM = "case when l_linenumber = 1 then 'error_table' when l_linenumber = 2 then 'error_file' else 'loaded' end"


@query("load_stats_stream", """
  select count(case when l_linenumber > 2 then 1 end) as loaded, count(case when l_linenumber = 2 then 1 end) as error_file,
    count(case when l_linenumber = 1 then 1 end) as error_table, count(case when l_linenumber < 3 then 1 end) as rejected,
    count(*) as source from lineitem""")
def load_stats_stream(spark, sf):
    return S.load_stats_stream(table(spark, sf, "lineitem").select(F.expr(_DISPOSITION_STREAM).alias("disposition")))


@query("load_stats_bulk", """
  select count(case when l_linenumber <> 4 then 1 end) as sent, count(case when l_linenumber > 4 then 1 end) as loaded,
    count(case when l_linenumber = 1 then 1 end) as err_table1, count(case when l_linenumber = 2 then 1 end) as err_table2,
    count(case when l_linenumber = 3 then 1 end) as duplicate, count(case when l_linenumber = 4 then 1 end) as err_file,
    count(*) as source, count(case when l_linenumber < 5 then 1 end) as rejected from lineitem""")
def load_stats_bulk(spark, sf):
    return S.load_stats_bulk(table(spark, sf, "lineitem").selectExpr(
        "case l_linenumber when 1 then 'err_table1' when 2 then 'err_table2' when 3 then 'duplicate' when 4 then 'err_file' "
        "else 'loaded' end as disposition"))


@query("drop_duplicate_rows", """
  select l_suppkey, l_returnflag, l_linestatus, (select count(*) from lineitem) -
    (select count(*) from (select distinct l_suppkey, l_returnflag, l_linestatus from lineitem)) as duplicates
  from (select distinct l_suppkey, l_returnflag, l_linestatus from lineitem)""")
def drop_duplicate_rows(spark, sf):
    rows, dropped = V.drop_duplicate_rows(table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus"))
    return rows.withColumn("duplicates", dropped.scalar())


_RANKED_SQL = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, row_number() over (
    partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_returnflag) as rn from lineitem"""


def _violations(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return V.unique_violations(rows, ["l_orderkey", "l_linenumber"], ["l_partkey"])


@query("unique_rows", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag from ({_RANKED_SQL}) where rn = 1")
def unique_rows(spark, sf):
    return _violations(spark, sf)[0]


@query("unique_violations", f"""
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, count(*) as copies from ({_RANKED_SQL}) where rn > 1
  group by 1, 2, 3, 4, 5""")
def unique_violations(spark, sf):
    return _violations(spark, sf)[1]


@query("null_string", """
  select o_orderkey, nullif(o_orderpriority, '5-LOW') as o_orderpriority, o_orderstatus from orders""")
def null_string(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return V.null_string(rows, "5-LOW", ["o_orderpriority"])


@query("repair_utf8", "select doc_id, concat(text, ' ', lang) as repaired from documents")
def repair_utf8(spark, sf):
    broken = table(spark, sf, "documents").select("doc_id", F.concat(
        F.encode("text", "UTF-8"), F.unhex(F.lit("FF")), F.encode("lang", "UTF-8")).cast("string").alias("text"))
    return broken.select("doc_id", V.repair_utf8("text").alias("repaired"))


def _errors(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "concat('F_', l_returnflag) as field", "cast(l_suppkey % 7 as int) as code", "concat(l_returnflag, l_linestatus) as message")


def _messages(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").selectExpr("n_nationkey as code", "concat('message ', n_name) as message").where("code <> 3")


@query("error_summary", "select concat('F_', l_returnflag) as field, cast(l_suppkey % 7 as int) as code, count(*) as rows from lineitem group by 1, 2")
def error_summary(spark, sf):
    return S.error_summary(_errors(spark, sf))


@query("error_summary_described", """
  select concat('F_', l_returnflag) as field, concat('message ', n_name) as message, count(*) as rows
  from lineitem join nation on n_nationkey = l_suppkey % 7 where n_nationkey <> 3 group by 1, 2""")
def error_summary_described(spark, sf):
    return S.error_summary_described(_errors(spark, sf).select("field", "code"), _messages(spark, sf))


@query("error_summary_ranked", "select concat(l_returnflag, l_linestatus) as message, count(*) as rows from lineitem group by 1 order by 2 desc, 1")
def error_summary_ranked(spark, sf):
    return S.error_summary_ranked(_errors(spark, sf))


@query("error_sample", f"""
  select l_orderkey, l_linenumber, l_partkey from lineitem where {WIDE_FLAG} order by l_orderkey, l_linenumber, l_partkey limit 10""")
def error_sample(spark, sf):
    rows = table(spark, sf, "lineitem").where(WIDE_FLAG).select("l_orderkey", "l_linenumber", "l_partkey")
    return S.error_sample(rows, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("classify_errors", """
  select code, count(*) as rows, case when code = 1159 then 'shown'
    when code in (1145, 1156, 1154, 1248, 1148, 1159, 1162, 1160, 1147) then 'ignored' else 'fatal' end as class
  from (select cast(1140 + l_partkey % 30 as int) as code from lineitem) group by 1""")
def classify_errors(spark, sf):
    return S.classify_errors(table(spark, sf, "lineitem").selectExpr("cast(1140 + l_partkey % 30 as int) as code"))


@query("auto_mode", """
  select doc_id, case when n_chars > 2000 then 'bulk' else 'default' end as mode,
    case when n_chars > 2000 then 80000 else 4000 end as batch_rows from documents""")
def auto_mode(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.mode_of(F.col("n_chars"), 2000).alias("m")).select("doc_id", "m.*")


@query("load", f"""
  select count(case when reason is null then 1 end) as loaded, count(reason) as rejected,
    cast(sum(case when reason is null then l_partkey end) as bigint) as parts,
    count(case when reason is not null and reason = 'arity' then 1 end) as short_lines from ({REASONED_SQL})""")
def load(spark, sf):
    source, rejects = scratch_path(spark, "source"), scratch_path(spark, "reject")
    lineitem_lines(spark, sf).write.text(source)
    name = _new_table(spark, "load", ", ".join(f"{c.name} {c.type}" for c in LINEITEM))
    L.load(spark, source, name, LoadSetting(delimiter="|", mode="auto", error_tolerance=0.5, reject_path=rejects), LINEITEM)
    turned = spark.read.text(rejects)
    return spark.table(name).agg(F.count(F.lit(1)).alias("loaded"), F.sum("l_partkey").alias("parts")).select(
        "loaded", "parts", turned.agg(F.count(F.lit(1))).scalar().alias("rejected"),
        turned.agg(F.count_if(F.col("value").contains("|"))).scalar().alias("short_lines"))


@query("bulk_load", ORDERS_TYPED_SQL)
def bulk_load(spark, sf):
    path = _exported_orders(spark, sf, ExportSetting(quoting=True, header=True))
    name = _new_table(spark, "bulk", ORDERS_DDL)
    L.bulk_load(spark, path, name, LoadSetting(quoting=True, header=True), ORDERS)
    return _dates_as_text(spark.table(name))
