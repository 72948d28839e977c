"""Joining points to the intervals that hold them, by a dyadic cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

_LEVEL, _BLOCK = "_range_level", "_range_block"


def whole(value: Column, kind: str) -> Column:
    """A value's place on the line of whole numbers: days for dates, microseconds for timestamps, else rounded down."""
    if kind == "date":
        return F.unix_date(value).cast("bigint")
    if kind.startswith("timestamp"):
        return F.unix_micros(value.cast("timestamp"))
    return F.floor(value).cast("bigint")


def cover(low: Column, high: Column) -> Column:
    """The (level, block) pairs that make up [low, high]: a block of level k holds 2**k whole numbers from a multiple of that on.

    At each level at most one block is cut off on either side, so an interval of n numbers has at most 2 log n of them, and
    no two overlap.
    """
    # What is left at level k is [up, down) in blocks of that level; odd ends do not fit into blocks of the next.
    def at(k: Column) -> Column:
        up, down = F.call_function("shiftright", low - 1, k) + 1, F.call_function("shiftright", high + 1, k)
        block = lambda test, number: F.when((up < down) & test, F.struct(k.alias("level"), number.alias("block")))
        return F.array(block(up % 2 != 0, up), block(down % 2 != 0, down - 1))

    levels = F.sequence(F.lit(0), F.ceil(F.log2(high.cast("double") - low.cast("double") + 2)).cast("int"))
    blocks = F.filter(F.flatten(F.transform(levels, at)), lambda b: b.isNotNull())
    return F.when(low <= high, blocks)


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, on: Sequence[str] = (),
               closed: str = "[)") -> DataFrame:
    """Rows of ``points`` with each row of ``intervals`` whose bounds hold the point and whose columns ``on`` are equal.

    ``closed`` tells which bounds belong to an interval. Long and short intervals need no common width: an interval is listed
    under the blocks of its cover, a point under its block of each level that some cover uses (at most 63 rows are
    asked for), and they meet by equality, each pair once. NULL points and bounds, and intervals that end before they begin, meet nothing.
    """
    if len(closed) != 2 or closed[0] not in "[(" or closed[1] not in "])":
        raise ValueError(f"{closed!r} is none of [] [) (] ()")
    clash = (set(points.columns) & set(intervals.columns)) - set(on)
    if clash:
        raise ValueError(f"both sides have the columns {sorted(clash)}")
    kind = dict(intervals.dtypes)[low]
    covered = intervals.withColumn("_cover", F.explode(cover(whole(F.col(low), kind), whole(F.col(high), dict(intervals.dtypes)[high]))))
    covered = covered.select(*intervals.columns, F.col("_cover.level").alias(_LEVEL), F.col("_cover.block").alias(_BLOCK))
    used = sorted(r[0] for r in covered.select(_LEVEL).distinct().collect())
    at = whole(F.col(point), dict(points.dtypes)[point])
    blocks = [F.struct(F.lit(k).alias("level"), F.shiftright(at, k).alias("block")) for k in used] or [
        F.struct(F.lit(0).alias("level"), at.alias("block"))]
    listed = points.where(F.col(point).isNotNull()).withColumn("_cover", F.explode(F.array(*blocks)))
    listed = listed.select(*points.columns, F.col("_cover.level").alias(_LEVEL), F.col("_cover.block").alias(_BLOCK))
    met = listed.join(covered, [*on, _LEVEL, _BLOCK])
    inside = (F.col(low) <= F.col(point)) if closed[0] == "[" else (F.col(low) < F.col(point))
    inside &= (F.col(point) <= F.col(high)) if closed[1] == "]" else (F.col(point) < F.col(high))
    return met.where(inside).drop(_LEVEL, _BLOCK)
