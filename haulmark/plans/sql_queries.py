"""SQL entry points and the relational surface they carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import tables as T
from ..operators.rangejoin import range_join
from ..session import pinned, scratch_path
from ..settings import ExportSetting
from ..sources import files as FS
from . import sqlapi as Q
from .load_queries import _new_table
from .registry import query, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _views(spark: SparkSession, sf: str, *names: str) -> None:
    for name in names:
        table(spark, sf, name).createOrReplaceTempView(name)


_TOP_CUSTOMER = "select c_custkey, c_name, c_acctbal > 0 as in_credit from customer order by c_acctbal desc, c_custkey"


@query("sql_read", f"""
  select unnest(['c_custkey', 'c_name', 'in_credit']) as name,
    unnest([cast(c_custkey as varchar), c_name, case when in_credit then 'yes' else 'no' end]) as value from ({_TOP_CUSTOMER} limit 1)""")
def sql_read(spark, sf):
    _views(spark, sf, "customer")
    return Q.row_pairs(spark.sql(_TOP_CUSTOMER))


@query("sql_export", """
  select concat_ws(',', n_name, count(*), cast(sum(cast(c_acctbal as decimal(12,2))) as decimal(22,2))) as line
  from customer join nation on c_nationkey = n_nationkey group by n_name""")
def sql_export(spark, sf):
    _views(spark, sf, "customer", "nation")
    path = scratch_path(spark, "sqlexport")
    Q.sql_export(spark, """select n_name, count(*) as n, sum(cast(c_acctbal as decimal(12,2))) as balance
        from customer join nation on c_nationkey = n_nationkey group by n_name""", path, ExportSetting(header=False))
    return FS.scan_compressed(spark, path).select(F.col("value").alias("line"))


@query("sql_execute", """
  select c_mktsegment, count(*) as n, count(*) filter (where c_mktsegment not in ('BUILDING', 'MACHINERY') and (c_custkey is null
    or c_custkey % 5 <> 0 and c_custkey not between 20 and 40 and c_custkey % 7 not in (2, 3) and not (c_custkey % 11 = 4))) as kept
  from customer where c_acctbal > 100 group by 1""")
def sql_execute(spark, sf):
    _views(spark, sf, "customer")
    name = _new_table(spark, "execute", "c_custkey bigint, c_mktsegment string")
    added = Q.sql_execute(spark, f"-- all that are in credit\nINSERT INTO {name} SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 100")
    every = pinned(spark.table(name).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), "executed")
    gone = sum(Q.sql_execute(spark, f"DELETE FROM {name} {where}") for where in (
        "WHERE c_custkey % 5 = 0", "AS t WHERE t.c_mktsegment IN ('BUILDING', 'MACHINERY')", "WHERE c_custkey BETWEEN 20 AND 40",
        "WHERE c_custkey % 7 NOT IN (0, 1, 4, 5, 6) /* that is 2, 3 */"))
    blank = Q.sql_execute(spark, f"UPDATE {name} SET c_mktsegment = NULL WHERE c_custkey % 11 = 4")
    gone += Q.sql_execute(spark, f"DELETE FROM {name} WHERE c_mktsegment IS NULL")
    left = spark.table(name).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("kept"))
    rows = every.alias("e").join(left.alias("k"), F.col("e.c_mktsegment").eqNullSafe(F.col("k.c_mktsegment")), "left").select(
        "e.c_mktsegment", "n", F.coalesce("kept", F.lit(0).cast("bigint")).alias("kept"))
    return rows.where(F.lit(added - gone == spark.table(name).count() and blank <= gone))


@query("sql_merge", """
  select o_orderkey, o_custkey, case when o_custkey % 3 = 0 then 'm' || o_orderstatus else o_orderstatus end as o_orderstatus
  from orders where o_orderstatus <> 'P' and not (o_custkey % 3 = 0 and o_orderstatus = 'F')
  union all select o_orderkey, -o_custkey, null from orders where o_orderstatus = 'P' and o_custkey % 3 = 0""")
def sql_merge(spark, sf):
    _views(spark, sf, "orders")
    name = _new_table(spark, "merge", "o_orderkey bigint, o_custkey bigint, o_orderstatus string")
    Q.sql_execute(spark, f"INSERT INTO {name} SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
    before = spark.table(name).count()
    rows = Q.sql_execute(spark, f"""
        MERGE INTO {name} AS t USING (SELECT * FROM orders WHERE o_custkey % 3 = 0) s ON t.o_orderkey = s.o_orderkey
        WHEN MATCHED AND s.o_orderstatus IN ('F') THEN DELETE
        WHEN MATCHED THEN UPDATE SET o_orderstatus = 'm' || t.o_orderstatus
        WHEN NOT MATCHED THEN INSERT (o_orderkey, o_custkey) VALUES (s.o_orderkey, -s.o_custkey)""")
    return spark.table(name).where(F.lit(before > 0 and rows > 0))


_DELETED = "o_orderstatus = 'F' and o_custkey % 10 < 4"


@query("delete_where", "select o_orderkey, o_custkey, o_orderstatus from orders where not (o_orderstatus = 'F' and o_custkey % 10 < 4)")
def delete_where(spark, sf):
    name = _new_table(spark, "delete", "o_orderkey bigint, o_custkey bigint, o_orderstatus string")
    T.insert_batch(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), name)
    T.delete_where(spark, name, _DELETED)
    return spark.table(name)


@query("update_where", """
  select o_orderkey, case when o_custkey % 10 < 4 then o_custkey + 1 else o_custkey end as o_custkey,
    case when o_custkey % 10 < 4 then lower(o_orderstatus) else o_orderstatus end as o_orderstatus from orders""")
def update_where(spark, sf):
    name = _new_table(spark, "update", "o_orderkey bigint, o_custkey bigint, o_orderstatus string")
    T.insert_batch(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), name)
    T.update_where(spark, name, {"o_custkey": "o_custkey + 1", "o_orderstatus": "lower(o_orderstatus)"}, "o_custkey % 10 < 4")
    return spark.table(name)


@query("sql_script", """
  select 'first' as which, count(*) as n from orders where o_orderstatus <> 'P'
  union all select 'second', count(*) from orders where o_orderstatus = 'P'
  union all select 'third', count(*) from orders where o_orderstatus = 'F' and o_custkey % 3 <> 0 and o_custkey not between 10 and 30
    and o_orderkey % 5 in (0, 1, 2)
  union all select 'fourth', count(*) from orders where o_custkey % 3 <> 0""")
def sql_script(spark, sf):
    _views(spark, sf, "orders")
    first, second, third, fourth = (_new_table(spark, "script", "o_orderkey bigint, o_custkey bigint") for _ in range(4))
    spark.sql(f"DROP TABLE {fourth}")
    rows = Q.sql_script(spark, f"""
        INSERT INTO {first} SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F';
        INSERT INTO {second} (o_orderkey, o_custkey) SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P';

        -- those that are open
        WITH open AS (SELECT * FROM orders WHERE o_orderstatus = 'O') INSERT INTO {first} SELECT o_orderkey, o_custkey FROM open;
        INSERT INTO {third} BY NAME SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F';
        UPDATE {third} SET o_orderkey = -1 WHERE o_custkey % 3 = 0;
        DELETE FROM {third} AS t WHERE t.o_orderkey < 0;
        DELETE FROM {third} WHERE o_custkey BETWEEN 10 AND 30 OR o_orderkey % 5 NOT IN (0, 1, 2);
        UPDATE {third} SET o_custkey = 0 WHERE o_custkey IS NULL OR o_custkey IN (-1, -2);
        CREATE TABLE {fourth} USING parquet AS SELECT o_orderkey FROM orders WHERE o_custkey % 3 <> 0;
        """)
    kept = spark.table(first).agg(F.count(F.lit(1)).alias("n")).select(F.lit("first").alias("which"), "n").unionByName(
        spark.table(second).agg(F.count(F.lit(1)).alias("n")).select(F.lit("second").alias("which"), "n"))
    left = spark.table(third).agg(F.count(F.lit(1)).alias("n")).select(F.lit("third").alias("which"), "n").unionByName(
        spark.table(fourth).agg(F.count(F.lit(1)).alias("n")).select(F.lit("fourth").alias("which"), "n").where(F.col("n") == rows[fourth]))
    counted = F.when(F.col("which") == "first", rows[first]).otherwise(rows[second])
    return kept.where(F.col("n") == counted).unionByName(left)


@query("sql_from_file", "select o_orderpriority, count(*) as n from orders where o_orderstatus = 'F' and o_custkey > 100 group by 1")
def sql_from_file(spark, sf):
    _views(spark, sf, "orders")
    path = scratch_path(spark, "statement")
    text = ("select o_orderpriority, count(*) as n from ${source}\n"
            "where o_orderstatus = '${status}' and o_custkey > :floor group by 1${?tail}")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return Q.sql_from_file(spark, path=path + "/*.txt",
                           variables={"source": "${name}", "name": "orders", "status": "F"}, args={"floor": 100})


def _sql(name: str, text: str, *views: str, spark_text: str | None = None):
    """Register a query whose text both engines take."""
    @query(name, text)
    def run(spark, sf) -> DataFrame:
        _views(spark, sf, *views)
        return spark.sql(spark_text or text)

    return run


_sql("project_expressions", """
  select l_orderkey, l_linenumber, l_partkey, cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as double) as net,
    l_quantity * 2 as doubled from lineitem""", "lineitem")

_sql("filter_predicates", """
  select l_orderkey, l_linenumber, l_partkey from lineitem
  where l_shipdate >= timestamp '1998-01-01 00:00:00' and l_shipdate < timestamp '1999-01-01 00:00:00'
    and l_discount between 0.05 and 0.07 and l_quantity < 24 and l_returnflag in ('A', 'N')""", "lineitem",
    spark_text="""select l_orderkey, l_linenumber, l_partkey from lineitem
  where l_shipdate >= timestamp_ntz '1998-01-01 00:00:00' and l_shipdate < timestamp_ntz '1999-01-01 00:00:00'
    and l_discount between 0.05 and 0.07 and l_quantity < 24 and l_returnflag in ('A', 'N')""")

_sql("join_inner", """
  select n_name, o_orderpriority, count(*) as items, cast(sum(cast(l_extendedprice as decimal(12,2))) as double) as price
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  group by n_name, o_orderpriority""", "lineitem", "orders", "customer", "nation")

_sql("join_left_outer", """
  select c_custkey, c_name, count(o_orderkey) as orders from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F'
  group by c_custkey, c_name""", "customer", "orders")

_sql("join_full_outer", """
  select coalesce(a.k, b.k) as k, a.n as parts, b.n as suppliers from
    (select p_size as k, count(*) as n from part group by 1) a full join
    (select s_nationkey as k, count(*) as n from supplier group by 1) b on a.k = b.k""", "part", "supplier")

_sql("join_semi", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')",
     "orders", "lineitem")

_sql("join_anti", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)",
     "orders", "lineitem")

@query("join_theta", """
  select r_name, count(*) as orders, cast(sum(cast(o_totalprice as decimal(12,2))) as double) as price
  from orders join (select r_name, r_regionkey * 100000 as low, (r_regionkey + 1) * 100000 as high from region
                    union all select r_name || ' (narrow)', r_regionkey * 1000, r_regionkey * 1000 + 37 from region
                    union all select 'any', -1, 100000000) band
    on o_totalprice >= low and o_totalprice < high group by r_name""")
def join_theta(spark, sf):
    regions = table(spark, sf, "region").selectExpr("r_name", "cast(r_regionkey as bigint) as r")
    bands = regions.selectExpr("r_name", "r * 100000 as low", "(r + 1) * 100000 as high").unionAll(
        regions.selectExpr("concat(r_name, ' (narrow)')", "r * 1000", "r * 1000 + 37")).unionAll(
        spark.range(1).selectExpr("'any'", "-1L", "100000000L"))
    met = range_join(table(spark, sf, "orders").select("o_totalprice"), bands, "o_totalprice", "low", "high")
    return met.groupBy("r_name").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("price"))


@query("join_validity", """
  select p.p_brand, count(*) as orders, count(distinct o_orderkey) as distinct_orders, sum(p.p_partkey) as parts
  from orders join (select p_partkey, p_brand, date '1995-01-01' + cast(p_partkey % 1500 as integer) as valid_from,
                           date '1995-01-01' + cast(p_partkey % 1500 + p_size as integer) as valid_to from part) p
    on cast(o_orderdate as date) >= valid_from and cast(o_orderdate as date) <= valid_to group by p.p_brand""")
def join_validity(spark, sf):
    parts = table(spark, sf, "part").selectExpr(
        "p_partkey", "p_brand", "date_add(date'1995-01-01', cast(p_partkey % 1500 as int)) as valid_from",
        "date_add(date'1995-01-01', cast(p_partkey % 1500 + p_size as int)) as valid_to")
    orders = table(spark, sf, "orders").selectExpr("o_orderkey", "cast(o_orderdate as date) as day")
    # All orders of a day meet the same parts, all parts of a span the same days, so days meet spans and their totals are
    # multiplied: the pairs of rows grow with the square of the tables. A key of several days is counted once a brand apart.
    n = F.count(F.lit(1))
    keyed = orders.where("day is not null and o_orderkey is not null")
    ends = keyed.groupBy("o_orderkey").agg(F.min("day").alias("day"), F.max("day").alias("last"))
    several = keyed.join(ends.where("day <> last").select("o_orderkey"), "o_orderkey", "left_semi").distinct()
    single = ends.where("day = last").groupBy("day").agg(n.alias("single"))
    days = orders.groupBy("day").agg(n.alias("n_orders")).join(single, "day", "left")
    spans = parts.groupBy("p_brand", "valid_from", "valid_to").agg(n.alias("n_parts"), F.sum("p_partkey").alias("keys"))
    met = pinned(range_join(days, spans, "day", "valid_from", "valid_to", closed="[]").groupBy("p_brand", "day", "n_orders", "single").agg(
        F.sum("n_parts").alias("n_parts"), F.sum("keys").alias("keys")), "validity")
    again = several.join(met.select("p_brand", "day"), "day").groupBy("p_brand").agg(F.countDistinct("o_orderkey").alias("several"))
    totals = met.groupBy("p_brand").agg(F.sum(F.col("n_orders") * F.col("n_parts")).alias("orders"),
                                        F.coalesce(F.sum("single"), F.lit(0)).alias("single"), F.sum(F.col("n_orders") * F.col("keys")).alias("parts"))
    return totals.alias("t").join(again.alias("a"), F.col("t.p_brand").eqNullSafe(F.col("a.p_brand")), "left").select(
        "t.p_brand", "orders", (F.col("single") + F.coalesce("several", F.lit(0))).alias("distinct_orders"), "parts")


_sql("group_count", """
  select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as decimal(12,2))) as double) as qty,
    cast(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))) as double) as net,
    min(l_partkey) as first_part, max(l_partkey) as last_part from lineitem group by l_returnflag, l_linestatus""", "lineitem")

_sql("having_filter", """
  select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12""", "orders")

_sql("distinct_aggregates", """
  select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers,
    count(distinct l_orderkey) as orders from lineitem group by l_returnflag""", "lineitem")

_sql("grouping_sets", """
  select o_orderstatus, o_orderpriority, count(*) as n from orders
  group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""", "orders")

_sql("rollup_totals", """
  select r_name, n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  group by rollup (r_name, n_name)""", "customer", "nation", "region")

_sql("cube_totals", "select c_mktsegment, c_nationkey, count(*) as n from customer group by cube (c_mktsegment, c_nationkey)", "customer")

_sql("window_functions", """
  select o_custkey, o_orderkey, cast(row_number() over w as bigint) as nth, lag(o_orderkey) over w as before,
    cast(sum(cast(o_totalprice as decimal(12,2))) over (partition by o_custkey order by o_orderdate, o_orderkey
      rows between unbounded preceding and current row) as double) as running
  from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""", "orders")

_sql("window_top_per_group", """
  select * from (select o_custkey, o_orderkey, cast(rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as place from orders) t
  where place <= 3""", "orders")

_sql("sort_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50", "orders")

_sql("set_union", """
  select c_nationkey as k from customer union select s_nationkey from supplier""", "customer", "supplier")

_sql("set_union_all", """
  select k, count(*) as n from (select c_nationkey as k from customer union all select s_nationkey from supplier) t group by k""",
     "customer", "supplier")

_sql("set_intersect", "select l_partkey as k from lineitem where l_returnflag = 'A' intersect select l_partkey from lineitem where l_returnflag = 'R'",
     "lineitem")

_sql("set_except_all", """
  select k, count(*) as n from (select l_suppkey as k from lineitem except all select o_custkey from orders) t group by k""",
     "lineitem", "orders")

_sql("subquery_scalar", """
  select c_custkey, c_name from customer where c_acctbal > (select avg(cast(c_acctbal as decimal(12,2))) from customer)""", "customer")

_sql("string_functions", """
  select p_partkey, upper(p_name) as up, cast(length(p_name) as bigint) as len, substr(p_name, 1, 4) as head, replace(p_brand, '#', '-') as brand,
    trim(concat('  ', p_type, ' ')) as kind, lpad(cast(p_size as varchar(10)), 5, '0') as padded, reverse(p_name) as back,
    cast(position('i' in p_name) as bigint) as at_i from part""", "part")

_sql("date_functions", """
  select o_orderkey, cast(year(o_orderdate) as bigint) as y, cast(month(o_orderdate) as bigint) as m, cast(day(o_orderdate) as bigint) as d, cast(quarter(o_orderdate) as bigint) as q,
    cast(date_trunc('month', o_orderdate) as date) < cast(o_orderdate as date) as after_first from orders""", "orders")

_sql("math_functions", """
  select l_orderkey, l_linenumber, l_partkey, abs(l_partkey - 1000) as gap, l_partkey % 7 as rest, cast(ceil(l_quantity / 7) as bigint) as up, cast(floor(l_quantity / 7) as bigint) as down,
    greatest(l_partkey, l_suppkey) as big, least(l_partkey, l_suppkey) as small, sqrt(l_quantity * l_quantity) as root from lineitem""", "lineitem")

_sql("conditional_functions", """
  select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'low' else 'high' end as band,
    coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as segment from customer""", "customer")


@query("json_functions", "select event_id, cast(props ->> 'k' as bigint) as k from events")
def json_functions(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("array_functions", """
  select doc_id, len(string_split(text, ' ')) as words, list_contains(string_split(text, ' '), 'the') as has_the,
    string_split(text, ' ')[1] as first_word from documents""")
def array_functions(spark, sf):
    words = F.split("text", " ", -1)
    return table(spark, sf, "documents").select(
        "doc_id", F.size(words).cast("bigint").alias("words"), F.array_contains(words, "the").alias("has_the"),
        F.get(words, 0).alias("first_word"))


@query("map_functions", """
  select o_orderkey, o_orderpriority as priority, 2 as entries, o_orderstatus as status from orders""")
def map_functions(spark, sf):
    pairs = F.create_map(F.lit("priority"), "o_orderpriority", F.lit("status"), "o_orderstatus")
    rows = table(spark, sf, "orders").select("o_orderkey", pairs.alias("m"))
    return rows.select("o_orderkey", F.col("m")["priority"].alias("priority"), F.size("m").alias("entries"), F.col("m")["status"].alias("status"))
