"""Iteration, layered values, run state, dependency tables, streaming and scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as GR, state as ST
from ..session import scratch_path
from ..settings import LoadSetting
from ..streaming import script_transform as transform_by_script, stream_load as load_stream
from .inputs import (LINEITEM, ORDER_EDGES_SQL, ORDER_NODES_SQL, REASONED_SQL, TURN_EDGES_SQL, TURN_NODES_SQL, lineitem_lines,
                     order_edges, order_nodes, turn_edges, turn_nodes)
from .load_queries import _new_table
from .registry import query, table


@query("for_all", """
  select b.iteration, concat('band$', cast(b.iteration as varchar)) as copy_name, count(*) as n
  from orders join (values (1, 0, 100000), (2, 100000, 200000), (3, 50000, 600000)) b(iteration, low, high)
    on o_totalprice >= low and o_totalprice < high group by 1, 2""")
def for_all(spark, sf):
    copies = ST.for_all(table(spark, sf, "orders").select("o_totalprice"), "band",
                        [{"low": 0, "high": 100000}, {"low": 100000, "high": 200000}, {"low": 50000, "high": 600000}])
    return copies.where("o_totalprice >= low and o_totalprice < high").groupBy("iteration", "copy_name").agg(
        F.count(F.lit(1)).alias("n"))


@query("for_all_expr", """
  select cast(1 + turn as integer) as iteration, concat('turn$', cast(1 + turn as varchar)) as copy_name, count(*) as n from conversations group by 1, 2""")
def for_all_expr(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("turn").agg(F.count(F.lit(1)).alias("n"))
    last = turns.agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0]
    bindings = ST.for_all_expr(spark, f"sequence(0, {last})", "turn")
    return bindings.join(turns, bindings["value"] == turns["turn"]).select("iteration", "copy_name", "n")


@query("group_iterations", """
  with i as (select o_orderkey + 1 as iteration from orders)
  select c.iteration as child, p.parent, 'success' as kind from i c, lateral (select unnest(range(
    (cast(ceil(c.iteration / 4.0) as bigint) - 2) * 4 + 1, (cast(ceil(c.iteration / 4.0) as bigint) - 1) * 4 + 1)) as parent) p where c.iteration > 4""")
def group_iterations(spark, sf):
    return ST.group_iterations(table(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("iteration")), 4)


_LAYERS = ["purchase", "click", "view", "signup"]


@query("layered_fallback", """
  select key, value, layer from (select user_id as key, cast(event_id as varchar) as value, event_type as layer, row_number() over (
    partition by user_id order by case event_type when 'purchase' then 1 when 'click' then 2 when 'view' then 3 else 4 end, cast(event_id as varchar)) as rn
    from events where event_type <> 'error') where rn = 1""")
def layered_fallback(spark, sf):
    entries = table(spark, sf, "events").select(
        F.col("event_type").alias("layer"), F.col("user_id").alias("key"), F.col("event_id").cast("string").alias("value"))
    return ST.layered_fallback(entries, _LAYERS)


@query("overlay", """
  select coalesce(b.k, a.k) as key, coalesce(b.v, a.v) as value from (select o_custkey as k, count(*) as v from orders group by 1) a
  full join (select c_custkey as k, c_nationkey as v from customer where c_acctbal > 0) b on a.k = b.k""")
def overlay(spark, sf):
    base = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    new = table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("bigint").alias("value"))
    return ST.overlay(base, new)


@query("overlay_maps", "select o_orderkey, 'old' as a, o_orderstatus as b, o_orderpriority as c from orders")
def overlay_maps(spark, sf):
    base = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("old"))
    new = F.create_map(F.lit("b"), F.col("o_orderstatus"), F.lit("c"), F.col("o_orderpriority"))
    rows = table(spark, sf, "orders").select("o_orderkey", ST.overlay_maps(base, new).alias("m"))
    return rows.select("o_orderkey", *[F.col("m")[k].alias(k) for k in "abc"])


@query("latest_state", """
  select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1""")
def latest_state(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return ST.latest_state(rows, ["user_id"], ["ts"]).drop("ts")


@query("pending", "select o_orderkey, o_orderstatus from orders where o_orderkey not in (select l_orderkey from lineitem where l_linestatus = 'F')")
def pending(spark, sf):
    done = table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ST.pending(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), done, ["o_orderkey"])


@query("run_stats", """
  select user_id as task, cast(min(ts) as varchar) as start_time, cast(max(ts) as varchar) as end_time, max_by(event_type, ts) as status,
    count(case when event_type = 'click' then 1 end) as attempts,
    cast(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) as bigint) as duration from events group by 1""")
def run_stats(spark, sf):
    log = table(spark, sf, "events").selectExpr(
        "user_id as task", "ts", "case when event_type = 'click' then 'RUNNING' else event_type end as status")
    out = ST.run_stats(log)
    return out.select("task", F.col("start_time").cast("string").alias("start_time"), F.col("end_time").cast("string").alias("end_time"),
                      F.when(F.col("status") == "RUNNING", "click").otherwise(F.col("status")).alias("status"), "attempts", "duration")


@query("extract_task_nodes", """
  select o_orderkey, concat('task', cast(o_custkey as varchar)) as name from orders where o_orderstatus <> 'P'""")
def extract_task_nodes(spark, sf):
    docs = table(spark, sf, "orders").selectExpr("o_orderkey", """concat('{"__hidden__": {"Component": "a", "Task": "b"}, "plain": 3, "task', cast(o_custkey as string),
        '": {"Component": "db", ', case when o_orderstatus = 'P' then '' else '"Task": "Load", ' end, '"params": {"n": [1, 2]}}}') as doc""")
    return GR.extract_task_nodes(docs, "o_orderkey", "doc").select("o_orderkey", "name")


@query("parse_dependencies", """
  select cast(o_orderkey as varchar) as child, cast(o_custkey as varchar) as parent, case when o_orderstatus = 'F' then 'success' else 'fail' end as kind
  from orders where o_orderstatus <> 'P'
  union all select cast(o_orderkey as varchar), 'all', 'complete' from orders where o_orderstatus = 'O'""")
def parse_dependencies(spark, sf):
    docs = table(spark, sf, "orders").selectExpr("cast(o_orderkey as string) as name", """case o_orderstatus
        when 'F' then concat('["', cast(o_custkey as string), '"]')
        when 'O' then concat('{"fail": ["', cast(o_custkey as string), '"], "complete": ["all"]}') end as dependencies""")
    return GR.parse_dependencies(docs, "name", "dependencies")


@query("dangling_refs", f"""
  with n as ({ORDER_NODES_SQL}), e as ({ORDER_EDGES_SQL})
  select child, parent, kind from e where parent not in (select name from n where status <> 'RUNNING')""")
def dangling_refs(spark, sf):
    return GR.dangling_refs(order_nodes(spark, sf).where("status <> 'RUNNING'"), order_edges(spark, sf))


@query("topo_levels", "select concat(cast(conv_id as varchar), '.', cast(turn as varchar)) as name, cast(turn + 1 as integer) as level from conversations")
def topo_levels(spark, sf):
    return GR.topo_levels(turn_nodes(spark, sf), turn_edges(spark, sf))


@query("find_cycles", f"""
  with recursive e as (select child, parent from ({TURN_EDGES_SQL})
      union all select concat(cast(conv_id as varchar), '.3'), concat(cast(conv_id as varchar), '.5') from conversations where turn = 5),
    behind(name) as (select child from e where parent like '%.5' and child like '%.3' union select e.child from e join behind on e.parent = behind.name)
  select name from behind""")
def find_cycles(spark, sf):
    back = table(spark, sf, "conversations").where("turn = 5").selectExpr(
        "concat(cast(conv_id as string), '.3') as child", "concat(cast(conv_id as string), '.5') as parent", "'success' as kind")
    return GR.find_cycles(turn_nodes(spark, sf), turn_edges(spark, sf).unionByName(back))


@query("leaf_nodes", f"select name, status from ({ORDER_NODES_SQL}) where name not in (select parent from ({ORDER_EDGES_SQL}))")
def leaf_nodes(spark, sf):
    return GR.leaf_nodes(order_nodes(spark, sf), order_edges(spark, sf))


@query("children", f"""
  select name, child, kind from ({ORDER_NODES_SQL}) join ({ORDER_EDGES_SQL}) on parent = name where kind = 'fail'""")
def children(spark, sf):
    return GR.children(order_nodes(spark, sf), order_edges(spark, sf), "fail")


@query("runnable_nodes", f"""
  with n as ({ORDER_NODES_SQL}), e as ({ORDER_EDGES_SQL})
  select name from n where status = 'READY' and not exists (select 1 from e left join n p on p.name = e.parent where e.child = n.name and not coalesce(
    case e.kind when 'success' then p.status in ('SUCCEEDED', 'SKIPPED', 'FAILURE_IGNORED') when 'fail' then p.status = 'FAILED_RECOVERED'
      else p.status in ('SUCCEEDED', 'SKIPPED', 'FAILURE_IGNORED', 'FAILED', 'INIT_FAILED', 'FAILED_RECOVERED') end, false))""")
def runnable_nodes(spark, sf):
    return GR.runnable_nodes(order_nodes(spark, sf), order_edges(spark, sf))


@query("propagate_status", f"""
  with recursive n as ({TURN_NODES_SQL}), e as ({TURN_EDGES_SQL}),
    dead(name) as (select e.child from e join n on n.name = e.parent join n c on c.name = e.child and c.status = 'READY'
        where (n.status = 'FAILED_RECOVERED' and e.kind = 'success') or (n.status = 'SUCCEEDED' and e.kind = 'fail')
      union select e.child from e join dead on e.parent = dead.name join n c on c.name = e.child and c.status = 'READY')
  select n.name, case when dead.name is null then n.status else 'DEACTIVATE' end as status from n left join dead on dead.name = n.name""")
def propagate_status(spark, sf):
    return GR.propagate_status(turn_nodes(spark, sf).select("name", "status"), turn_edges(spark, sf))


@query("status_rollup", f"""
  select count(*) as nodes, count(case when status = 'RUNNING' then 1 end) as running, count(case when status = 'FAILED_RECOVERED' then 1 end) as failed,
    count(case when status in ('SUCCEEDED', 'SKIPPED') then 1 end) as succeeded,
    count(case when status in ('SUCCEEDED', 'SKIPPED', 'FAILED_RECOVERED') then 1 end) as complete,
    count(case when status in ('SUCCEEDED', 'SKIPPED', 'FAILED_RECOVERED') then 1 end) as terminal, false as has_completed from ({ORDER_NODES_SQL})""")
def status_rollup(spark, sf):
    return GR.status_rollup(order_nodes(spark, sf))


@query("splice", f"""
  with e as ({TURN_EDGES_SQL}), s as (select name from ({TURN_NODES_SQL}) where turn = 2)
  select case when child in (select name from s) then concat(child, '$a') else child end as child,
    case when parent in (select name from s) then concat(parent, '$b') else parent end as parent, kind from e
  union all select concat(name, '$b'), concat(name, '$a'), 'success' from s""")
def splice(spark, sf):
    replaced = turn_nodes(spark, sf).where("turn = 2").select(F.col("name").alias("node"))
    sub_nodes = replaced.select("node", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"))
    sub_edges = replaced.select("node", F.lit("b").alias("child"), F.lit("a").alias("parent"), F.lit("success").alias("kind"))
    return GR.splice(turn_edges(spark, sf), sub_nodes, sub_edges)


@query("stream_load", f"select l_returnflag, count(*) as n from ({REASONED_SQL}) where reason is null group by 1")
def stream_load(spark, sf):
    source, state = scratch_path(spark, "arriving"), scratch_path(spark, "stream")
    lineitem_lines(spark, sf).write.text(source)
    name = _new_table(spark, "streamed", ", ".join(f"{c.name} {c.type}" for c in LINEITEM) + ", batch bigint", "batch")
    load_stream(spark, source, name, state, LoadSetting(delimiter="|", error_tolerance=0.5), LINEITEM,
                reject_path=scratch_path(spark, "streamrejects"), files_per_batch=1000).awaitTermination()
    return spark.table(name).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("script_transform", "select cast(o_orderkey as varchar) as o_orderkey, o_orderpriority from orders")
def script_transform(spark, sf):
    return transform_by_script(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "cat", "o_orderkey string, o_orderpriority string")
