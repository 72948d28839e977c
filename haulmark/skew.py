"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 16
# A key is worth treating apart from this many rows on; the heaviest ``HOT_KEYS`` are.
HOT_ROWS = 1_000_000
HOT_KEYS = 1000

_KEEPS_ROWS_ONLY = ("inner", "left", "left_semi", "left_anti")


def _check(how: str) -> None:
    if how not in _KEEPS_ROWS_ONLY:
        raise ValueError(f"a {how!r} join would repeat unmatched lookups")


def salted_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Join ``rows`` to a ``lookup`` that is unique on ``on`` and much smaller than ``rows``.

    Rows of one key are spread over ``salts`` groups by a hash of the whole row and of the task that
    holds it (so that copies of a row spread as well), and the lookup is repeated per group. It reads
    ``rows`` once, so it suits rows that are costly to compute.
    """
    _check(how)
    mixed = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns], F.spark_partition_id())
    salted = rows.withColumn("_salt", F.pmod(mixed, F.lit(salts)))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def hot_keys(rows: DataFrame, on: Sequence[str], floor: int = HOT_ROWS) -> DataFrame | None:
    """The heaviest keys with at least ``floor`` rows, at most ``HOT_KEYS`` of them; None if there are none.

    One pre-aggregated count over the key columns and a top-n. It need not be complete: keys it leaves
    out are joined the usual way.
    """
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= floor)
    found = counts.orderBy(F.desc("_n")).limit(HOT_KEYS).select(*on)
    keys = found.collect()
    return rows.sparkSession.createDataFrame(keys, found.schema) if keys else None


def split_hot_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner",
                   floor: int = HOT_ROWS) -> DataFrame:
    """Join ``rows`` to a ``lookup`` that is unique on ``on`` and may be as large as ``rows``.

    Without hot keys this is a plain join. Otherwise the rows of hot keys meet a broadcast of the
    lookup cut to those keys (at most ``HOT_KEYS`` rows, so its size is bounded) and stay where they
    are, the others are joined by shuffle, and rows with a NULL key, which match nothing, go around.
    """
    return join_with_hot(rows, lookup, on, hot_keys(rows, on, floor), how)


def join_with_hot(rows: DataFrame, lookup: DataFrame, on: Sequence[str], hot: DataFrame | None,
                  how: str = "inner") -> DataFrame:
    """The same with the hot keys already known."""
    _check(how)
    if hot is None:
        return rows.join(lookup, list(on), how)
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in on])
    keys = F.broadcast(hot)
    hot_lookup = F.broadcast(lookup.join(keys, list(on), "left_semi"))
    apart = rows.join(keys, list(on), "left_semi").join(hot_lookup, list(on), how)
    rest = rows.where(whole).join(keys, list(on), "left_anti").join(lookup, list(on), how)
    out = rest.unionByName(apart)
    if how in ("left", "left_anti"):
        out = out.unionByName(rows.where(~whole), allowMissingColumns=True)
    return out


def spread_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", floor: int = HOT_ROWS) -> DataFrame:
    """Join ``rows`` to a ``lookup`` that may have any number of rows a key.

    ``rows`` is read twice. Rows of a hot key are dealt to as many groups as they hold ``floor`` rows, and its rows of the
    lookup are repeated for each group; rows with a NULL key, which match nothing, are dealt to any task. Only the hot keys
    (at most ``HOT_KEYS``) are broadcast. Copies of a row are dealt apart where different tasks hold them.
    """
    _check(how)
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= floor)
    heavy = counts.orderBy(F.desc("_n")).limit(HOT_KEYS).select(*on, F.ceil(F.col("_n") / floor).cast("int").alias("_groups"))
    found = heavy.collect()
    if not found:
        return rows.join(lookup, list(on), how)
    keys = [r for r in found if all(r[c] is not None for c in on)]
    hot = F.broadcast(rows.sparkSession.createDataFrame(keys, heavy.schema))
    mixed = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns], F.spark_partition_id())
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in on])
    groups = F.coalesce("_groups", F.lit(1))
    dealt = rows.join(hot, list(on), "left").withColumn(
        "_group", F.when(missing, F.pmod(mixed, F.lit(1 << 30))).otherwise(F.pmod(mixed, groups)).cast("int")).drop("_groups")
    repeated = lookup.join(hot, list(on), "left").withColumn("_group", F.explode(F.sequence(F.lit(0), groups - 1))).drop("_groups")
    return dealt.join(repeated, [*on, "_group"], how).drop("_group")
