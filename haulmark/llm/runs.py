"""Periodic runs of words by Baier grouping.

A run is a stretch of words with a smallest period, long enough and not extended by a neighbour. Its Lyndon root, the least
rotation of a period, is the longest Lyndon word at some place of the run under one of two opposite orders of the words. So:

1. Phase one of Baier's suffix sorter groups the suffixes by their first word and takes the groups from the highest down. Each
   suffix of the group points at the nearest earlier suffix of a lower group; suffixes that are pointed at move to a group of
   their own above their old one, the higher the more often, and their context grows by the group's context each time. When a
   group's turn comes, its context is the longest Lyndon word at its suffixes: the Lyndon array, without phase two.
2. That is done under both orders, and each root (place, length) is extended to both sides by the longest common extension
   of its place and the place one root later: a binary search on prefix hashes, for all roots at once. Runs found are then
   compared word by word; should a hash ever have lied, another base is taken. So results are exact.

Before that, what cannot hold a run is left out: in a run of at least six words and four periods, each window of three words
occurs three times or more. Stretches of such windows, counted in their document and then in their stretch, are sorted;
ordinary prose has almost none. Many documents are worked on at once, with words between them that occur nowhere else; a text of
any length is worked on whole, in memory in proportion to it.

Null, empty and blank texts have no words and no runs. Each row is judged alone, so repeated rows and rows with equal ids are
judged alike; ties between runs are settled by the caller's order of (start, period). Only the columns asked for are read,
whatever else the table holds. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import map_slices, mixed, raw_text
from .registry import query, table

LEAST_WORDS = 6
LEAST_PERIODS = 4
TOGETHER = 1 << 18  # words worked on at once, unless one text has more
PRIMES = (2**31 - 1, 2**31 - 19)


class _Numbers(dict):
    """Word -> number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def lyndon_lengths(ranks: Sequence[int]) -> list[int]:
    """Length of the longest Lyndon word at each place: phase one of Baier's sorter. ``ranks`` are from 0, without gaps."""
    n, top = len(ranks), max(ranks, default=-1)
    members: list[list[int]] = [[] for _ in range(top + 1)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    group, context = list(ranks), [1] * (top + 1)
    below = list(range(-1, top))
    above = [*range(1, top + 1), -1]
    left = list(range(n))  # the place itself while its group waits, then a place further left
    lengths = [0] * n
    now = top
    while now >= 0:
        here = [i for i in members[now] if group[i] == now]
        size = context[now]
        for i in here:
            lengths[i], left[i] = size, i - 1
        pointed: dict[int, int] = {}
        for i in here:
            p = i - 1
            while p >= 0 and left[p] != p:
                p = left[p]
            q = i
            while q > p and left[q] != p:
                left[q], q = p, left[q]
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for p, times in pointed.items():
            moves.setdefault((times, group[p]), []).append(p)
        for times, old in sorted(moves, reverse=True):  # the more often first, so that the less often goes beneath
            new, high = len(members), above[old]
            members.append(moves[times, old])
            context.append(context[old] + times * size)
            below.append(old)
            above.append(high)
            above[old] = new
            if high >= 0:
                below[high] = new
            for p in members[new]:
                group[p] = new
        now = below[now]
    return lengths


class Extensions:
    """Longest common extensions of pairs of places, by prefix hashes modulo two primes."""

    def __init__(self, symbols: np.ndarray, seed: int = 0):
        self.n = len(symbols)
        self.parts = []
        for prime in PRIMES:
            base = 1_000_003 + 7_919 * seed
            power = np.ones(1, np.int64)
            step = base
            while len(power) <= self.n:
                power = np.concatenate([power, power * step % prime])
                step = step * step % prime
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum((symbols + 1) * power[:self.n] % prime, out=sums[1:])
            self.parts.append((prime, power, sums % prime))

    def _same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for prime, power, sums in self.parts:
            x = (sums[a + size] - sums[a]) % prime * power[b - a] % prime
            ok &= x == (sums[b + size] - sums[b]) % prime
        return ok

    def _longest(self, most: np.ndarray, same) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = same(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words from ``a`` and from ``b`` > ``a`` on that agree."""
        return self._longest(self.n - b, lambda size: self._same(a, b, size))

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words before ``a`` and before ``b`` > ``a`` that agree."""
        return self._longest(a.copy(), lambda size: self._same(a - size, b - size, size))


def _holds(w: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether [start, end) has the period and neither neighbour extends it."""
    return (np.array_equal(w[start:end - period], w[start + period:end]) and (start == 0 or w[start - 1] != w[start - 1 + period])
            and (end == len(w) or w[end] != w[end - period]))


def runs_of(symbols: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of at least ``least`` words and ``periods`` >= 2 periods, in order of start and period."""
    if len(symbols) < least:
        return []
    ranks = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    roots = [np.array(lyndon_lengths(r.tolist()), np.int64) for r in (ranks, ranks.max() - ranks)]
    places = np.arange(len(ranks))
    pairs = np.unique(np.concatenate([np.stack([places, places + r], 1)[places + r < len(ranks)] for r in roots]), axis=0)
    a, b = pairs[:, 0], pairs[:, 1]
    for seed in range(64):
        reach = Extensions(ranks, seed)
        back, ahead = reach.backward(a, b), reach.forward(a, b)
        size = back + (b - a) + ahead
        good = size >= np.maximum(least, periods * (b - a))
        found = np.unique(np.stack([a - back, b + ahead, b - a], 1)[good], axis=0)
        out = sorted((s, e, p) for s, e, p in found.tolist())
        if all(_holds(ranks, *r) for r in out):
            return sorted(out, key=lambda r: (r[0], r[2]))
    raise ArithmeticError("64 hash bases in a row gave false extensions")


def stretches(symbols: np.ndarray, owner: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """[start, end) of the stretches that may hold a run: all windows of three words occur three times in their owner, then
    in their stretch."""
    width = 3
    starts = np.flatnonzero(owner[width - 1:] == owner[:len(owner) - width + 1]) if len(owner) >= width else np.zeros(0, np.int64)
    w = symbols.astype(np.uint64)
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    inside = owner[starts].astype(np.uint64)
    for _ in range(2):
        if not len(starts):
            return []
        key = mixed(mixed(mixed(inside * odd[3] + w[starts] * odd[0]) + w[starts + 1] * odd[1]) + w[starts + 2] * odd[2])
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
        often = np.zeros(len(key), bool)
        often[order] = np.repeat(np.diff(edge) >= width, np.diff(edge))
        starts, inside = starts[often], inside[often]
        fresh = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(inside) != 0)]) if len(starts) else np.zeros(0, bool)
        number = np.cumsum(fresh) - 1
        count = np.bincount(number)
        long_ = (count >= least - width + 1)[number]
        starts, inside = starts[long_], number[long_].astype(np.uint64)
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(inside) != 0)])) if len(starts) else np.zeros(0, np.int64)
    last = np.append(fresh[1:], len(starts)) - 1
    return list(zip(starts[fresh].tolist(), (starts[last] + width).tolist())) if len(starts) else []


def runs_in(texts: list[np.ndarray], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several texts of numbered words, as (start, length, period) by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    symbols, owner, first = np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    if least >= LEAST_WORDS and periods >= LEAST_PERIODS:
        spans = stretches(symbols, owner, least)
    else:
        spans = [(int(f), int(f + n)) for f, n in zip(first, sizes) if n]
    if not spans:
        return out
    unused = int(symbols.max()) + 1
    joined = np.concatenate([x for i, (s, e) in enumerate(spans) for x in (symbols[s:e], [unused + i])])
    place = np.concatenate([np.arange(s, e + 1) for s, e in spans])
    for s, e, p in runs_of(joined, least, periods):
        at = int(place[s])
        doc = int(owner[at])
        out[doc].append((at - int(first[doc]), e - s, p))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def planted_order(n: int, h: int) -> np.ndarray | None:
    """Which word stands where after the test repetition of hash ``h``; None where nothing changes."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def periodic_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", least: int = LEAST_WORDS,
                  periods: int = LEAST_PERIODS, planted: Column | None = None) -> DataFrame:
    """``keep`` (of type long), n_words, starts, lengths and periods of the runs, and ``collapsed``: the words that are left, joined by
    a space, when each run keeps its first period only. ``planted`` (long) first repeats words as ``planted_order`` says."""
    names = [f"_k{i}" for i in range(len(keep))]
    seed = (F.lit(1) if planted is None else planted).cast("long").alias("_planted")
    read = docs.select(*(F.col(k).cast("long").alias(n) for k, n in zip(keep, names)), seed, raw_text(text).alias("_text"))

    def setup():
        def work(rows: list[tuple]) -> Iterator[tuple]:
            numbers = _Numbers()
            texts = []
            for *_, words, order in rows:
                w = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                texts.append(w if order is None else w[order])
            for (*cells, words, order), found in zip(rows, runs_in(texts, least, periods)):
                if order is not None:
                    words = [words[i] for i in order.tolist()]
                n = len(words)
                if found:
                    edge = np.zeros(n + 1, np.int64)
                    for s, size, p in found:
                        edge[s + p] += 1
                        edge[s + size] -= 1
                    words = [x for x, gone in zip(words, (np.cumsum(edge[:-1]) > 0).tolist()) if not gone]
                starts, lengths, each = zip(*found) if found else ((), (), ())
                yield (*cells, n, list(starts), list(lengths), list(each), b" ".join(words))

        def fn(columns: list[list]) -> Iterator[tuple]:
            waiting, size = [], 0
            for *cells, h, body in zip(*columns):
                words = (body or b"").split()
                waiting.append((*cells, words, planted_order(len(words), 1 if h is None else h)))
                size += len(words)
                if size >= TOGETHER:
                    yield from work(waiting)
                    waiting, size = [], 0
            yield from work(waiting)

        return fn

    schema = [*((n, "long") for n in names), ("n_words", "long"), ("starts", "array<long>"), ("lengths", "array<long>"),
              ("periods", "array<long>"), ("collapsed", "binary")]
    out = map_slices(read, setup, schema)
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keep)), *(n for n, _ in schema[len(names):]))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = periodic_runs(table(spark, sf, "documents"), planted=h).withColumn("runs", F.arrays_zip("starts", "lengths", "periods"))
    none = F.lit(None).cast(found.schema["runs"].dataType.elementType)
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["lengths"] * b["periods"] > b["lengths"] * r["periods"]), r).otherwise(b))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(
        r["starts"].cast("string"), F.lit(","), r["lengths"].cast("string"), F.lit(","), r["periods"].cast("string"), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.starts").alias("start"), F.col("best.lengths").alias("length"),
        F.col("best.periods").alias("period"), F.expr("(1000 * best.lengths) div best.periods").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
