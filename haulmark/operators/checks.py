"""Conditions, expectations and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.predicates import predicate_text, predicate_tree
from ..session import pinned


class ExpectationFailed(AssertionError):
    """A checked expectation does not hold."""


def when(df: DataFrame, state: DataFrame, condition: Any) -> DataFrame:
    """``df`` if the condition holds for some row of ``state`` (usually one row), else no rows.

    The condition is an uncorrelated subquery: it runs once and stops at its first hit.
    """
    return df.where(state.where(predicate_tree(condition)).exists())


def expectations(df: DataFrame, checks: Sequence[tuple[Any, str]]) -> DataFrame:
    """One row per check: ``check_no, expression, description, failed_rows, passed``.

    All checks are counted in one pass over ``df``; a NULL outcome counts as failed.
    """
    counts = df.agg(*[
        F.count_if(~F.coalesce(predicate_tree(tree), F.lit(False))).alias(f"_f{i}") for i, (tree, _) in enumerate(checks)])
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("check_no"), F.lit(predicate_text(tree)).alias("expression"),
                 F.lit(text).alias("description"), F.col(f"_f{i}").alias("failed_rows"),
                 (F.col(f"_f{i}") == 0).alias("passed"))
        for i, (tree, text) in enumerate(checks)])
    return counts.select(F.inline(rows))


def expect(df: DataFrame, checks: Sequence[tuple[Any, str]]) -> None:
    """Raise when any check fails."""
    failed = expectations(df, checks).where(~F.col("passed")).collect()
    if failed:
        raise ExpectationFailed("; ".join(
            f"{r['description']}: {r['expression']} ({r['failed_rows']} rows)" for r in failed))


def reconcile(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: row counts of both sides, keys on one side only, keys with other row counts, ``matched``.

    Both sides are counted by key before they meet, so no key's rows are gathered.
    """
    both = source.select(*keys, F.lit(1).alias("_s"), F.lit(0).alias("_t")).unionByName(
        target.select(*keys, F.lit(0).alias("_s"), F.lit(1).alias("_t")))
    per_key = both.groupBy(*keys).agg(F.sum("_s").alias("_s"), F.sum("_t").alias("_t"))
    return per_key.agg(
        F.coalesce(F.sum("_s"), F.lit(0)).alias("source_rows"), F.coalesce(F.sum("_t"), F.lit(0)).alias("target_rows"),
        F.count_if(F.col("_t") == 0).alias("missing_keys"), F.count_if(F.col("_s") == 0).alias("extra_keys"),
        F.count_if((F.col("_s") > 0) & (F.col("_t") > 0) & (F.col("_s") != F.col("_t"))).alias("uneven_keys"),
    ).withColumn("matched", (F.col("missing_keys") + F.col("extra_keys") + F.col("uneven_keys")) == 0)


_BUCKET, _SIDE = "_bucket", "_side"


def _content_hashes(columns: Sequence[str], seeds: Sequence[int]) -> list[Column]:
    """Row hashes by seed. NULLs are hashed as their own flag, since ``xxhash64`` skips them."""
    parts = [c for name in columns for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
    return [F.xxhash64(F.lit(seed), *parts) for seed in seeds]


def content_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int) -> DataFrame:
    """Rows and order-free sums of two row hashes by bucket of the keys; no row is shuffled.

    Sums are of 32-bit halves, so that they fit for any table of less than 2**31 rows a bucket.
    """
    bucket = F.pmod(_content_hashes(keys, [1])[0], F.lit(buckets))
    halves = [half for h in _content_hashes(columns, [2, 3]) for half in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    hashed = df.select(bucket.alias(_BUCKET), *(h.alias(f"_h{i}") for i, h in enumerate(halves)))
    return hashed.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("_rows"), *(F.sum(f"_h{i}").alias(f"_h{i}") for i in range(len(halves))))


def unequal_buckets(source: DataFrame, target: DataFrame, keys: Sequence[str], buckets: int = 4096) -> DataFrame:
    """The buckets of keys whose rows are not the same on both sides; ``target`` has the columns and types of ``source``."""
    sums = [content_sums(side, keys, source.columns, buckets) for side in (source, target)]
    both = sums[0].unionByName(sums[1])
    figures = [c for c in both.columns if c != _BUCKET]
    one_side = F.count(F.lit(1)) < 2
    return both.groupBy(_BUCKET).agg((one_side | reduce(Column.__or__, [F.min(c) != F.max(c) for c in figures])).alias("_differs")).where(
        "_differs").select(_BUCKET)


def reconcile_contents(source: DataFrame, target: DataFrame, keys: Sequence[str], buckets: int = 4096) -> DataFrame:
    """Keys whose rows differ: ``keys``, ``kind`` (missing, extra or changed), and the rows that only one side has.

    Each side is read once for sums by bucket. Only the buckets that differ (at most ``buckets``, so they are broadcast) are
    read again, and their rows are counted by content, with copies combined before the shuffle; what does not cancel is
    reported by key. Equal tables end after the sums. Columns are met by name; those of ``target`` take the types of ``source``.
    """
    if sorted(source.columns) != sorted(target.columns):
        raise ValueError(f"columns differ: {sorted(set(source.columns) ^ set(target.columns))}")
    target = target.select(*(F.col(f"`{n}`").cast(t).alias(n) for n, t in source.dtypes))
    bad = pinned(unequal_buckets(source, target, keys, buckets), "unequal-buckets")
    near = lambda side, sign: side.withColumn(_BUCKET, F.pmod(_content_hashes(keys, [1])[0], F.lit(buckets))).join(
        F.broadcast(bad), _BUCKET, "left_semi").drop(_BUCKET).withColumn(_SIDE, F.lit(sign))
    rows = near(source, 1).unionByName(near(target, -1)).groupBy(*source.columns).agg(F.sum(_SIDE).alias(_SIDE)).where(F.col(_SIDE) != 0)
    only = rows.groupBy(*keys).agg(F.sum(F.greatest(_SIDE, F.lit(0))).alias("source_only"), F.sum(F.greatest(-F.col(_SIDE), F.lit(0))).alias("target_only"))
    kind = F.when(F.col("target_only") == 0, "missing").when(F.col("source_only") == 0, "extra").otherwise("changed")
    return only.select(*keys, kind.alias("kind"), "source_only", "target_only")
