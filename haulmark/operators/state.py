"""Iteration, layered values and run-state tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.literals import as_column


def for_all(df: DataFrame, name: str, bindings: Sequence[Mapping[str, Any]]) -> DataFrame:
    """One copy of ``df`` per binding, in one plan.

    Adds ``iteration`` (1, 2, ..), ``copy_name`` (``name$i``) and the bound values; a bound value
    takes the place of a column of the same name. The bindings are written out in the query, so they
    are few; ``df`` is read once.
    """
    fields = list(dict.fromkeys(k for b in bindings for k in b))
    rows = F.array(*[
        F.struct(F.lit(i).alias("iteration"), F.lit(f"{name}${i}").alias("copy_name"),
                 *[_bound(b.get(k), df, k) for k in fields])
        for i, b in enumerate(bindings, start=1)])
    copies = df.select("*", F.explode(rows).alias("_b"))
    kept = [F.col(c) for c in df.columns if c not in fields]
    return copies.select(*kept, "_b.*")


def _bound(value: Any, df: DataFrame, name: str) -> Column:
    """A bound value, or the column it would override where this binding leaves it out."""
    if value is None and name in df.columns:
        return F.col(name).alias(name)
    return F.lit(value).alias(name)


def for_all_expr(spark: SparkSession, expr: str, name: str) -> DataFrame:
    """Bindings from a Spark SQL array expression such as ``sequence(1, 10)``: ``iteration, copy_name, value``."""
    return spark.range(1).select(F.posexplode(F.expr(expr)).alias("_i", "value")).select(
        (F.col("_i") + 1).alias("iteration"),
        F.concat(F.lit(f"{name}$"), (F.col("_i") + 1).cast("string")).alias("copy_name"), "value")


def iteration_group(iteration: Column | str, group: int) -> Column:
    """The 1-based group an iteration runs in."""
    return F.ceil(as_column(iteration) / F.lit(group)).cast("bigint")


def group_iterations(iterations: DataFrame, group: int = 1, allow_failure: bool = False) -> DataFrame:
    """Edges ``child, parent, kind`` between iterations: each waits for all of the group before it.

    ``group`` bounds the parents of one iteration. The kind is ``complete`` when failures are allowed,
    else ``success``. The first group has no parents.
    """
    grp = iteration_group("iteration", group)
    first = (grp - 2) * group + 1
    parents = F.when(grp > 1, F.sequence(first, first + group - 1))
    return iterations.select(
        F.col("iteration").alias("child"), F.explode(parents).alias("parent"),
        F.lit("complete" if allow_failure else "success").alias("kind"))


def layered_fallback(entries: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Per key the value of the highest-priority layer that has it: ``key, value, layer``.

    Input ``(layer, key, value)``; layers are named from highest to lowest priority.
    """
    order = F.array_position(F.lit(list(priority)), F.col("layer"))
    return entries.withColumn("_order", order).where("_order > 0").groupBy("key").agg(
        F.min(F.struct("_order", "value", "layer")).alias("_best")).select("key", "_best.value", "_best.layer")


def overlay(base: DataFrame, new: DataFrame) -> DataFrame:
    """New ``(key, value)`` over old; keys missing in the new keep their value."""
    both = base.select("key", "value", F.lit(1).alias("_rank")).unionByName(
        new.select("key", "value", F.lit(0).alias("_rank")))
    return both.groupBy("key").agg(F.min(F.struct("_rank", "value")).alias("_best")).select("key", "_best.value")


def overlay_maps(base: Column | str, new: Column | str) -> Column:
    """The same for map columns: keys of either, the new value where there is one."""
    return F.map_zip_with(as_column(base), as_column(new), lambda _, a, b: F.coalesce(b, a))


def latest_state(df: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last record per key; ties fall to the largest of the remaining columns."""
    rest = [c for c in df.columns if c not in set(key) and c not in set(order_by)]
    best = df.groupBy(*key).agg(F.max(F.struct(*order_by, *rest)).alias("_best"))
    return best.select(*[c if c in set(key) else F.col(f"_best.{c}").alias(c) for c in df.columns])


def pending(work: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Work items without a finished record."""
    return work.join(done.select(*key).distinct(), list(key), "left_anti")


def run_stats(log: DataFrame) -> DataFrame:
    """One record per task from its state log ``(task, ts, status)``.

    Start and end are the first and last entry, the status is that of the last, attempts counts the
    ``RUNNING`` entries, and the duration is in whole seconds.
    """
    runs = log.groupBy("task").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.max(F.struct("ts", "status")).getField("status").alias("status"),
        F.count_if(F.col("status") == "RUNNING").alias("attempts"))
    return runs.withColumn("duration", seconds_between("start_time", "end_time"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from start to end."""
    return F.timestamp_diff("SECOND", as_column(start), as_column(end))
