"""What loops share: the tables of their rounds, and pointers that double their reach a round."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .session import pinned, scratch_path
from .skew import split_hot_join


class Runs:
    """The tables that rounds leave behind, merged as a binary counter carries.

    After n rounds there are at most log n tables, and a row has been written at most log n times, so a round that reads all
    that came before opens few files and its plan stays small.
    """

    def __init__(self, label: str, merge: Callable[[DataFrame], DataFrame]):
        self.label, self.merge = label, merge
        self.tables: list[tuple[int, DataFrame]] = []

    def add(self, table: DataFrame) -> None:
        rank, same = 0, [table]
        while self.tables and self.tables[-1][0] == rank:
            same.append(self.tables.pop()[1])
            rank += 1
        if rank:
            table = pinned(self.merge(reduce(DataFrame.unionByName, same)), self.label)
        self.tables.append((rank, table))

    def rows(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, [t for _, t in self.tables]) if self.tables else None


def climb(parents: DataFrame) -> DataFrame:
    """Follow single parents to where they end: ``name, to, dist, hit`` for every node whose path does.

    ``parents(name, to, hit)`` has one row a node. A path ends at the first node without a row of its own (``to``, ``dist`` edges away),
    or at the first node that is hit, the node itself included (``hit``). Each round replaces a pointer by the pointer of what it
    points to, so a path of n edges takes log n rounds, and a round writes only nodes that are still under way. Nodes that run
    into a cycle without a hit have no end and no row: once a round brings no node to its end, none of the rest has one.
    """
    spark = parents.sparkSession
    path, rounds = scratch_path(spark, "climb"), 0
    inner = parents.select(F.col("name").alias("to"), F.lit(True).alias("_inner"))
    start = split_hot_join(parents, inner, ["to"], "left").select(
        "name", "to", F.lit(1).alias("dist"), "hit", (~F.col("hit") & F.coalesce("_inner", F.lit(False))).alias("open"))
    schema = "name string, to string, dist int, hit boolean, open boolean, round int"
    while True:
        table = pinned(start, "climb", f"{path}/round={rounds}")
        counts = {r["open"]: r["count"] for r in table.groupBy("open").count().collect()}
        ended = spark.read.schema(schema).parquet(path).where("not open").drop("round", "open")
        if not counts.get(True) or not counts.get(False):
            return ended
        under_way = table.where("open")
        step = ended.withColumn("open", F.lit(False)).unionByName(under_way).select(
            F.col("name").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_dist"), F.col("hit").alias("_hit"), F.col("open").alias("_open"))
        start = split_hot_join(under_way, step, ["to"]).select(
            "name", F.col("_to").alias("to"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_hit").alias("hit"), F.col("_open").alias("open"))
        rounds += 1
