"""Frames the queries share, all derived row by row from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import TargetColumn, names, target
from .registry import table

LINEITEM: list[TargetColumn] = target(
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "decimal(12,2)"), ("l_extendedprice", "decimal(12,2)"), ("l_discount", "decimal(4,2)"),
    ("l_tax", "decimal(4,2)"), ("l_returnflag", "varchar(1)"), ("l_linestatus", "varchar(1)"), ("l_shipdate", "date"))
LINEITEM_NAMES = names(LINEITEM)

ORDERS: list[TargetColumn] = target(
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "varchar(1)"), ("o_totalprice", "decimal(12,2)"),
    ("o_orderdate", "date"), ("o_orderpriority", "string"))

# Which rows are broken and how; the same tests in the SQL below.
BAD_KEY = "l_orderkey % 97 = 0"
BLANK_QUANTITY = "l_partkey % 53 = 0"
WIDE_FLAG = "l_suppkey % 41 = 0"
SHORT_LINE = "(l_orderkey + l_linenumber) % 89 = 0"


def lineitem_text(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` as text columns, some cells broken by a rule on the row's own keys."""
    return table(spark, sf, "lineitem").selectExpr(
        f"concat(cast(l_orderkey as string), case when {BAD_KEY} then 'x' else '' end) as l_orderkey",
        "cast(l_partkey as string) as l_partkey", "cast(l_suppkey as string) as l_suppkey",
        "cast(l_linenumber as string) as l_linenumber",
        f"case when {BLANK_QUANTITY} then '' else cast(cast(l_quantity as decimal(12,2)) as string) end as l_quantity",
        "cast(cast(l_extendedprice as decimal(12,2)) as string) as l_extendedprice",
        "cast(cast(l_discount as decimal(4,2)) as string) as l_discount",
        "cast(cast(l_tax as decimal(4,2)) as string) as l_tax",
        f"concat(l_returnflag, case when {WIDE_FLAG} then '+' else '' end) as l_returnflag",
        "l_linestatus", "cast(cast(l_shipdate as date) as string) as l_shipdate",
        f"{SHORT_LINE} as _short")


def lineitem_lines(spark: SparkSession, sf: str, delimiter: str = "|") -> DataFrame:
    """The same as delimited lines ``value``; a short line lacks its last field."""
    cells = lineitem_text(spark, sf)
    whole = F.array(*LINEITEM_NAMES)
    return cells.select(F.array_join(
        F.when(F.col("_short"), F.slice(whole, 1, len(LINEITEM) - 1)).otherwise(whole), delimiter).alias("value"))


def lineitem_export(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` with types whose text form is the same everywhere."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cast(l_quantity as decimal(12,2)) as l_quantity",
        "cast(l_extendedprice as decimal(12,2)) as l_extendedprice", "cast(l_discount as decimal(4,2)) as l_discount",
        "cast(l_tax as decimal(4,2)) as l_tax", "l_returnflag", "l_linestatus", "cast(l_shipdate as date) as l_shipdate")


def orders_export(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus", "cast(o_totalprice as decimal(12,2)) as o_totalprice",
        "cast(o_orderdate as date) as o_orderdate", "o_orderpriority")


# The rows of ``lineitem`` with the reason each is rejected for, in the SQL dialect of the checks.
REASONED_SQL = f"""
  select *, case when {SHORT_LINE} then 'arity' when {BAD_KEY} then 'cast:l_orderkey'
                 when {WIDE_FLAG} then 'width:l_returnflag' end as reason
  from lineitem"""


def turn_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation turn is a node; its status follows from its role."""
    return table(spark, sf, "conversations").selectExpr(
        "concat(cast(conv_id as string), '.', cast(turn as string)) as name",
        "case when turn = 0 and conv_id % 2 = 0 then 'SUCCEEDED' when turn = 0 then 'FAILED_RECOVERED' else 'READY' end as status",
        "conv_id", "turn", "role")


def turn_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A turn depends on the one before it; the kind follows from the role of the child."""
    return table(spark, sf, "conversations").where("turn > 0").selectExpr(
        "concat(cast(conv_id as string), '.', cast(turn as string)) as child",
        "concat(cast(conv_id as string), '.', cast(turn - 1 as string)) as parent",
        "case when turn % 3 = 1 then 'success' when turn % 3 = 2 then 'complete' else 'fail' end as kind")


def order_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Each order is a node with a run status taken from its priority."""
    return table(spark, sf, "orders").selectExpr("concat('o', cast(o_orderkey as string)) as name", f"{STATUS_CASE} as status")


def order_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each line item makes its order depend on the order with the number of its part."""
    return table(spark, sf, "lineitem").selectExpr(
        "concat('o', cast(l_orderkey as string)) as child", "concat('o', cast(l_partkey as string)) as parent",
        "case l_returnflag when 'A' then 'success' when 'N' then 'complete' else 'fail' end as kind").distinct()


STATUS_CASE = (
    "case when o_orderpriority = '1-URGENT' then 'SUCCEEDED' when o_orderpriority = '2-HIGH' then 'FAILED_RECOVERED' "
    "when o_orderpriority = '3-MEDIUM' then 'SKIPPED' when o_orderpriority = '5-LOW' and o_orderstatus = 'F' then 'RUNNING' "
    "else 'READY' end")

ORDER_NODES_SQL = f"select concat('o', cast(o_orderkey as varchar)) as name, {STATUS_CASE} as status from orders"
ORDER_EDGES_SQL = """select distinct concat('o', cast(l_orderkey as varchar)) as child, concat('o', cast(l_partkey as varchar)) as parent,
  case l_returnflag when 'A' then 'success' when 'N' then 'complete' else 'fail' end as kind from lineitem"""
TURN_EDGES_SQL = """select concat(cast(conv_id as varchar), '.', cast(turn as varchar)) as child,
  concat(cast(conv_id as varchar), '.', cast(turn - 1 as varchar)) as parent,
  case when turn % 3 = 1 then 'success' when turn % 3 = 2 then 'complete' else 'fail' end as kind
  from conversations where turn > 0"""
TURN_NODES_SQL = """select concat(cast(conv_id as varchar), '.', cast(turn as varchar)) as name,
  case when turn = 0 and conv_id % 2 = 0 then 'SUCCEEDED' when turn = 0 then 'FAILED_RECOVERED' else 'READY' end as status,
  conv_id, turn, role from conversations"""


def log_lines(spark: SparkSession, sf: str, line: str) -> DataFrame:
    """``events`` as a job log: the user is the job, the event the line."""
    return table(spark, sf, "events").selectExpr("user_id as job_id", "event_id as line_no", f"{line} as line")
