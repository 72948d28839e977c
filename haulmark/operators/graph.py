"""Dependency tables: ``nodes(name, status)`` and ``edges(child, parent, kind)``.

The iterative operators first climb paths of single parents by doubling pointers, then go round by round over the nodes that
changed in the last one. What a round finds is written to the shared folder, so lineage stays short and survives a lost
executor. A parent with a large share of the edges is joined apart from the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.literals import as_column
from ..rounds import Runs, climb
from ..session import pinned, scratch_path
from ..skew import HOT_ROWS, hot_keys, join_with_hot, split_hot_join, spread_join

# Statuses by meaning, dependency kinds, and the keys of a task entry.
SUCCESSFUL = ("SUCCEEDED", "SKIPPED", "FAILURE_IGNORED")
FAILED = ("FAILED", "INIT_FAILED", "FAILED_RECOVERED")
COMPLETE = (*SUCCESSFUL, *FAILED)
TERMINAL = (*COMPLETE, "DEACTIVATE")
KINDS = ("success", "fail", "complete")
COMPONENT_KEY = "Component"
TASK_KEY = "Task"
SEPARATOR = "$"


def extract_task_nodes(docs: DataFrame, key: str, col: str) -> DataFrame:
    """Task entries of JSON documents: ``<key>, name, payload``.

    Kept are object entries that hold both a component and a task and whose name is not ``__like_this__``.
    """
    entries = docs.select(key, F.explode(F.from_json(F.col(col), "map<string,string>")).alias("name", "payload"))
    body = F.col("payload")
    return entries.where(
        ~(F.col("name").startswith("__") & F.col("name").endswith("__")) & body.startswith("{")
        & F.get_json_object(body, f"$.{COMPONENT_KEY}").isNotNull() & F.get_json_object(body, f"$.{TASK_KEY}").isNotNull())


def parse_dependencies(df: DataFrame, name: str, col: str) -> DataFrame:
    """Edges from a JSON dependency field: an array lists success parents, an object has one list per
    kind. Any other field in the object is an error; a NULL field has no edges."""
    text = F.trim(F.col(col))
    by_kind = F.from_json(text, "map<string,array<string>>")
    unknown = F.array_except(F.map_keys(by_kind), F.lit(list(KINDS)))
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(
        F.lit("unknown dependency field: "), F.array_join(unknown, ", "))).cast("map<string,array<string>>")).otherwise(by_kind)
    parents = F.when(text.startswith("["), F.create_map(F.lit("success"), F.from_json(text, "array<string>"))) \
        .when(text.startswith("{"), checked)
    return df.select(F.col(name).alias("child"), F.explode(parents).alias("kind", "_parents")).select(
        "child", F.explode("_parents").alias("parent"), "kind")


def dangling_refs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose parent is no node."""
    return split_hot_join(edges.withColumnRenamed("parent", "name"), nodes.select("name").distinct(), ["name"], "left_anti") \
        .select("child", F.col("name").alias("parent"), "kind")


def leaf_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes no one depends on."""
    return nodes.join(edges.select(F.col("parent").alias("name")).distinct(), "name", "left_anti")


def children(nodes: DataFrame, edges: DataFrame, kind: str = "all") -> DataFrame:
    """``name, child, kind`` for every node and the nodes that depend on it."""
    wanted = pinned(edges if kind == "all" else edges.where(F.col("kind") == kind), "links")
    return split_hot_join(wanted.withColumnRenamed("parent", "name"), nodes.select("name").distinct(), ["name"]) \
        .select("name", "child", "kind")


def topo_levels(nodes: DataFrame, edges: DataFrame, max_level: int | None = None) -> DataFrame:
    """``name, level``: level 1 has no parents, others come one level after their last parent.

    A node on or behind a cycle has no level (NULL), nor has a NULL name or a level beyond ``max_level``. Edges to unknown
    nodes count as unmet. A node with one parent is that many levels after the node its single parents lead to, so chains and
    trees of any depth are climbed in a logarithm of their depth. What remains are nodes with several parents: a round joins
    those just placed to the arcs between them and adds up how many parents each has met; there are as many rounds as such
    nodes follow one another. Waiting nodes are kept in runs that are merged as they double, without those placed meanwhile.
    """
    spark = nodes.sparkSession
    names = pinned(nodes.select("name").distinct(), "names")
    links = pinned(edges.select("child", "parent").distinct(), "links")
    above = links.groupBy(F.col("child").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("to"))
    above = pinned(above.join(names, "name", "left_semi"), "above")
    ends = climb(above.where("n = 1").select("name", "to", F.lit(False).alias("hit"))).drop("hit")

    meets = split_hot_join(links, above.where("n > 1").select(F.col("name").alias("child")), ["child"])
    arcs = pinned(split_hot_join(meets.withColumnRenamed("parent", "name"), ends, ["name"], "left").groupBy(
        "child", F.coalesce("to", "name").alias("anchor")).agg(F.max(F.coalesce("dist", F.lit(0)) + 1).alias("dist")), "arcs")
    waits = pinned(arcs.groupBy(F.col("child").alias("name")).agg(F.count(F.lit(1)).alias("waits")), "waits")
    hot = hot_keys(arcs, ["anchor"])
    most = lambda df: df.groupBy("name").agg(F.max("met").alias("met"), F.max("level").alias("level"), F.max("waits").alias("waits"))
    runs = Runs("waiting", lambda df: most(df).where("met < waits"))
    found, round_no = scratch_path(spark, "levels"), 0
    first = names.join(above, "name", "left_anti").where("name is not null").select(
        "name", F.lit(0).cast("bigint").alias("met"), F.lit(1).alias("level"), F.lit(0).cast("bigint").alias("waits"))
    table = pinned(first, "levels", f"{found}/round=0")
    fresh = table
    while not fresh.isEmpty():
        round_no += 1
        met = join_with_hot(arcs, fresh.select(F.col("name").alias("anchor"), "level"), ["anchor"], hot).groupBy(
            F.col("child").alias("name")).agg(F.count(F.lit(1)).alias("met"), F.max(F.col("level") + F.col("dist")).alias("level"))
        earlier = runs.rows()
        if earlier is not None:
            before = most(earlier).select("name", F.col("met").alias("_met"), F.col("level").alias("_level"))
            met = met.join(before, "name", "left").select(
                "name", (F.col("met") + F.coalesce("_met", F.lit(0))).alias("met"), F.greatest("level", "_level").alias("level"))
        table = pinned(met.join(waits, "name"), "levels", f"{found}/round={round_no}")
        fresh = table.where("met = waits")
        runs.add(table)
    placed = spark.read.schema("name string, met bigint, level int, waits bigint, round int").parquet(found).where("met = waits").select("name", "level")
    lower = split_hot_join(ends, placed.withColumnRenamed("name", "to"), ["to"]).select("name", (F.col("level") + F.col("dist")).alias("level"))
    levels = placed.unionByName(lower)
    if max_level is not None:
        levels = levels.where(F.col("level") <= max_level)
    return names.join(levels, "name", "left")


def find_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that can never be placed: those on a cycle or behind one."""
    return topo_levels(nodes, edges).where(F.col("level").isNull()).select("name")


def is_met(kind: Column, parent_status: Column) -> Column:
    """Whether a dependency is met by the status of its parent."""
    return (
        F.when(kind == "success", parent_status.isin(*SUCCESSFUL))
        .when(kind == "fail", parent_status == "FAILED_RECOVERED")
        .when(kind == "complete", parent_status.isin(*COMPLETE))
    )


def runnable_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """READY nodes whose dependencies are all met."""
    parents = nodes.select(F.col("name").alias("parent"), F.col("status").alias("_status"))
    unmet = split_hot_join(pinned(edges, "links"), parents, ["parent"], "left").where(
        ~F.coalesce(is_met(F.col("kind"), F.col("_status")), F.lit(False)))
    blocked = unmet.select(F.col("child").alias("name")).distinct()
    return nodes.where(F.col("status") == "READY").join(blocked, "name", "left_anti").select("name")


def propagate_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Deactivate nodes that can no longer run: ``name, status``.

    A recovered failure deactivates success children, a success deactivates fail children, and a
    deactivated node deactivates all its children. Only nodes that are not finished change. A node with one unfinished
    parent shares the fate of whatever its single parents lead to, so chains and trees are climbed in a logarithm of their depth;
    rounds follow only nodes with several unfinished parents, each from those deactivated in the round before.
    """
    spark = nodes.sparkSession
    links = pinned(edges.select("child", "parent", "kind").distinct(), "links")
    hot = hot_keys(links, ["parent"])
    state = pinned(nodes.select("name", "status"), "state")
    open_nodes = pinned(state.where(~F.col("status").isin(*TERMINAL)).select("name").distinct(), "open")
    ended = state.where(F.col("status").isin("DEACTIVATE", "FAILED_RECOVERED", *SUCCESSFUL)).select(F.col("name").alias("parent"), F.col("status").alias("_ps"))
    kills = ((F.col("_ps") == "DEACTIVATE") | ((F.col("_ps") == "FAILED_RECOVERED") & (F.col("kind") == "success"))
             | (F.col("_ps").isin(*SUCCESSFUL) & (F.col("kind") == "fail")))
    struck = join_with_hot(links, ended, ["parent"], hot).where(kills).select(F.col("child").alias("name")).distinct()
    struck = pinned(struck.join(open_nodes, "name", "left_semi"), "struck")

    inner = join_with_hot(links, open_nodes.withColumnRenamed("name", "parent"), ["parent"], hot).select("child", "parent").distinct()
    inner = pinned(split_hot_join(pinned(inner, "links"), open_nodes.withColumnRenamed("name", "child"), ["child"]), "links")
    above = pinned(inner.groupBy(F.col("child").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("to")), "above")
    single = above.where("n = 1").join(struck.withColumn("hit", F.lit(True)), "name", "left").select(
        "name", "to", F.coalesce("hit", F.lit(False)).alias("hit"))
    ends = climb(pinned(single, "single"))

    meets = split_hot_join(inner, above.where("n > 1").select(F.col("name").alias("child")), ["child"])
    arcs = pinned(split_hot_join(meets.withColumnRenamed("parent", "name"), ends, ["name"], "left").select(
        "child", F.coalesce("to", "name").alias("anchor"), F.coalesce("hit", F.lit(False)).alias("hit")).distinct(), "arcs")
    hot = hot_keys(arcs, ["anchor"])
    runs = Runs("dead", lambda df: df)
    found, round_no = scratch_path(spark, "deactivated"), 0
    first = struck.unionByName(arcs.where("hit").select(F.col("child").alias("name"))).distinct()
    fresh = pinned(first, "deactivated", f"{found}/round=0")
    while not fresh.isEmpty():
        runs.add(fresh)
        round_no += 1
        hits = join_with_hot(arcs, fresh.withColumnRenamed("name", "anchor"), ["anchor"], hot).select(F.col("child").alias("name")).distinct()
        fresh = pinned(hits.join(runs.rows(), "name", "left_anti"), "deactivated", f"{found}/round={round_no}")
    dead = spark.read.schema("name string, round int").parquet(found).select("name")
    below = ends.where("hit").select("name").unionByName(
        split_hot_join(ends.where("not hit"), dead.withColumnRenamed("name", "to"), ["to"], "left_semi").select("name"))
    gone = dead.unionByName(below).distinct().withColumn("_gone", F.lit(True))
    return state.join(gone, "name", "left").select(
        "name", F.when(F.col("_gone"), F.lit("DEACTIVATE")).otherwise(F.col("status")).alias("status"))


def status_rollup(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Node counts by meaning of status and whether all nodes have finished."""
    s = F.col("status")
    return nodes.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(s == "RUNNING").alias("running"),
        F.count_if(s.isin(*FAILED)).alias("failed"), F.count_if(s.isin(*SUCCESSFUL)).alias("succeeded"),
        F.count_if(s.isin(*COMPLETE)).alias("complete"), F.count_if(s.isin(*TERMINAL)).alias("terminal"),
        F.coalesce(F.bool_and(s.isin(*TERMINAL)), F.lit(True)).alias("has_completed"))


def splice(edges: DataFrame, sub_nodes: DataFrame, sub_edges: DataFrame, floor: int = HOT_ROWS) -> DataFrame:
    """Replace nodes by their subgraphs; returns all edges.

    ``sub_nodes(node, name)`` and ``sub_edges(node, child, parent, kind)`` give each replaced node's
    subgraph. Its nodes are renamed ``node$name``; those without parents take over the node's own
    parents, and whoever depended on the node now depends on every one without children. The edges of a replaced node
    are dealt to several tasks if it has ``floor`` of them or more.
    """
    def full(node: str, name: str) -> Column:
        return F.concat(as_column(node), F.lit(SEPARATOR), as_column(name))

    inner = sub_edges.select(full("node", "child").alias("child"), full("node", "parent").alias("parent"), "kind")
    roots = sub_nodes.join(sub_edges.select("node", F.col("child").alias("name")).distinct(), ["node", "name"], "left_anti") \
        .select("node", full("node", "name").alias("_root"))
    leaves = sub_nodes.join(sub_edges.select("node", F.col("parent").alias("name")).distinct(), ["node", "name"], "left_anti") \
        .select("node", full("node", "name").alias("_leaf"))
    # A child that is itself replaced hands the edge to its roots, a replaced parent to its leaves.
    down = spread_join(edges.select("child", "parent", "kind"), roots.withColumnRenamed("node", "child"), ["child"], "left", floor).select(
        F.coalesce("_root", "child").alias("child"), "parent", "kind")
    up = spread_join(pinned(down, "spliced"), leaves.withColumnRenamed("node", "parent"), ["parent"], "left", floor).select(
        "child", F.coalesce("_leaf", "parent").alias("parent"), "kind")
    return up.unionByName(inner)
