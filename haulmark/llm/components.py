"""Connected components of a table of links by contraction."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import pinned


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def contraction(links: DataFrame) -> list[DataFrame]:
    """The pointer tables (node, to) of each round, from the first to the last.

    A round orders the nodes anew (by their bits against a mask of its own, so no order of the ids lasts), points each at
    the least of itself and its neighbours, follows that pointer once more, and relabels the links with what is reached;
    links inside a node go. A chain in any order keeps less than four fifths of its nodes a round and mostly under half, a star one. Minima are combined
    before the shuffle, and the joins' other side has one row a node, so that a hub's links can be split.
    """
    links = pinned(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        mask = F.lit(_signed(xxhash.xxh64_intdigest(b"round %d" % len(rounds)))).cast("long")
        turned = lambda c: F.col(c).cast("long").bitwiseXOR(mask)  # noqa: E731 - its own inverse
        both = links.select(F.col("a").alias("node"), turned("b").alias("other")).unionByName(
            links.select(F.col("b").alias("node"), turned("a").alias("other")))
        least: Column = F.least(F.min("other"), turned("node")).bitwiseXOR(mask)
        first = pinned(both.groupBy("node").agg(least.alias("to")), "points")
        step = first.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        points = pinned(first.join(step, "to").select("node", F.col("_next").alias("to")), "points")
        rounds.append(points)
        a, b = (points.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        moved = links.join(a, "a").join(b, "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        links = pinned(moved.where("a < b").distinct(), "links")
    return rounds


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), of type long; the root is the same for all nodes of a component.

    Pointer tables are followed from the last, smallest round back to the first, each step written, so that no plan holds
    more than one join and all steps together write about as many rows as the first.
    """
    rounds = contraction(links)
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    out = rounds[-1]
    for points in reversed(rounds[:-1]):
        step = out.select(F.col("node").alias("to"), F.col("to").alias("_root"))
        out = pinned(points.join(step, "to", "left").select("node", F.coalesce("_root", "to").alias("to")), "roots")
    return out.withColumnRenamed("to", "root")
