"""Range joins against nested loops, contents of tables against plain comparison."""

from __future__ import annotations

import datetime
import random

import pytest

from haulmark.operators.checks import reconcile_contents, unequal_buckets
from haulmark.operators.rangejoin import range_join
from haulmark.plans import sql_queries


@pytest.mark.parametrize("closed", ["[)", "[]", "(]", "()"])
@pytest.mark.parametrize("kind", ["long", "double", "date"])
def test_range_join_equals_nested_loops(spark, kind, closed):
    rnd = random.Random(closed + kind)
    make = {"long": lambda: rnd.randint(-70, 70), "double": lambda: rnd.choice([rnd.uniform(-9, 9), float(rnd.randint(-9, 9))]),
            "date": lambda: datetime.date(1969, 12, 1) + datetime.timedelta(rnd.randint(0, 90))}[kind]
    some = lambda: None if rnd.random() < 0.05 else make()
    points = [(i, rnd.choice("ab"), some()) for i in range(150)]
    spans = []
    for j in range(80):
        low, high = some(), some()
        if low is not None and high is not None and rnd.random() < 0.9:
            low, high = min(low, high), max(low, high)
        spans.append((j, rnd.choice("ab"), low, high))
    if kind == "long":
        points += [(900, "a", 2**61), (901, "a", -2**61)]
        spans += [(900, "a", -2**62, 2**62), (901, "b", 5, 5)]
    above, below = (lambda x, y: x <= y) if closed[0] == "[" else (lambda x, y: x < y), (lambda x, y: x <= y) if closed[1] == "]" else (lambda x, y: x < y)
    fits = lambda p, s: None not in (p[2], s[2], s[3]) and above(s[2], p[2]) and below(p[2], s[3])
    left = spark.createDataFrame(points, f"i long, g string, at {kind}")
    right = spark.createDataFrame(spans, f"j long, h string, low {kind}, high {kind}")
    got = range_join(left, right, "at", "low", "high", closed=closed)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((p[0], s[0]) for p in points for s in spans if fits(p, s))
    keyed = range_join(left, right.withColumnRenamed("h", "g"), "at", "low", "high", ["g"], closed)
    assert sorted((r.i, r.j) for r in keyed.collect()) == sorted((p[0], s[0]) for p in points for s in spans if p[1] == s[1] and fits(p, s))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_range_join_of_nothing_and_bad_settings(spark):
    none = spark.createDataFrame([], "low long, high long")
    assert range_join(spark.range(3), none, "id", "low", "high").count() == 0
    with pytest.raises(ValueError):
        range_join(spark.range(3), none, "id", "low", "high", closed="[[")
    with pytest.raises(ValueError):
        range_join(spark.range(3), spark.range(3), "id", "id", "id")


def test_long_intervals_are_listed_few_times(spark):
    from haulmark.operators.rangejoin import cover
    got = spark.createDataFrame([(-12345, 10**15 + 7), (0, 2**40 - 1), (5, 5), (3, 2)], "a long, b long").select("a", "b", cover(*map(__import__("pyspark").sql.functions.col, "ab")).alias("c")).collect()
    sizes = {(r.a, r.b): None if r.c is None else len(r.c) for r in got}
    assert sizes[(0, 2**40 - 1)] == 1 and sizes[(5, 5)] == 1 and sizes[(3, 2)] is None and sizes[(-12345, 10**15 + 7)] <= 100
    for r in got:
        if r.c:
            blocks = sorted((x.block << x.level, (x.block + 1) << x.level) for x in r.c)
            assert blocks[0][0] == r.a and blocks[-1][1] == r.b + 1 and all(x[1] == y[0] for x, y in zip(blocks, blocks[1:]))


def test_contents(spark):
    ddl = "k long, a string, b double"
    rows = [(i % 700, None if i % 7 == 0 else f"v{i % 5}", i / 3) for i in range(2000)] + [(None, "n", None), (None, None, None)]
    source = spark.createDataFrame(rows, ddl)
    same = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), ddl).select("b", "k", "a").repartition(5)
    assert unequal_buckets(source, same.select("k", "a", "b"), ["k"]).count() == 0 and reconcile_contents(source, same, ["k"]).count() == 0
    other = [r for r in rows if r[0] != 3]  # missing key
    other = [(r[0], "changed", r[2]) if r[0] == 4 and r[2] < 2 else r for r in other]
    again = other[10]
    other += [again, (5000, "x", 0.0)]  # a copy, a new key
    other[other.index((None, "n", None))] = (None, None, None)  # swaps a value for NULL; another row is like it
    other = [(r[0], r[2], r[1]) for r in other]
    got = {r[0]: tuple(r)[1:] for r in reconcile_contents(source, spark.createDataFrame(other, "k long, b double, a string"), ["k"]).collect()}
    assert got == {3: ("missing", sum(r[0] == 3 for r in rows), 0), 4: ("changed", 1, 1), again[0]: ("extra", 0, 1), 5000: ("extra", 0, 1), None: ("changed", 1, 1)}
    hot = spark.range(30_000).selectExpr("0L as k", "id % 3 as v")
    assert [tuple(r) for r in reconcile_contents(hot, hot.where("v < 2"), ["k"]).collect()] == [(0, "missing", 10_000, 0)]
    assert reconcile_contents(hot.limit(0), hot.limit(0), ["k"]).count() == 0
    with pytest.raises(ValueError):
        reconcile_contents(source, source.drop("a"), ["k"])


def test_values_that_move_between_columns_are_seen(spark):
    a = spark.createDataFrame([(1, None, "x")], "k long, a string, b string")
    b = spark.createDataFrame([(1, "x", None)], "k long, a string, b string")
    assert unequal_buckets(a, b, ["k"]).count() == 1


def test_equal_tables_shuffle_bucket_sums_only(spark):
    source = spark.range(1000).selectExpr("id as k", "cast(id as string) as text")
    plan = unequal_buckets(source, source, ["k"])._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "_bucket" in line and "text" not in line


def test_validity_meets_days_with_spans(spark, tmp_path, monkeypatch):
    """Orders of one day and parts of one span are met at once; keys repeat, also on other days, and anything may be null."""
    rnd, start = random.Random(3), datetime.datetime(1995, 1, 1)
    orders = [(rnd.choice([None, *range(90)]) if i < 200 else i, rnd.choice([None, start + datetime.timedelta(rnd.randint(-5, 40), rnd.randint(0, 86_399))]) if i < 300
               else start + datetime.timedelta(3)) for i in range(600)]
    parts = [(rnd.choice([None, rnd.randint(0, 3), rnd.randint(1500, 1520)]), rnd.choice([None, "a", "b", "c"]), rnd.choice([None, 0, 2, 30])) for _ in range(80)]
    parts += [(2, "a", 5)] * 200
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    pairs = {}
    for brand, key, part in ((b, o, k) for o, at in orders if at for k, b, size in parts
                             if k is not None and size is not None and k % 1500 <= (at - start).days <= k % 1500 + size):
        pairs.setdefault(brand, []).append((key, part))
    want = {(b, len(x), len({k for k, _ in x} - {None}), sum(p for _, p in x)) for b, x in pairs.items()}
    sizes = []
    monkeypatch.setattr(sql_queries, "range_join", lambda *a, **b: (found := range_join(*a, **b), sizes.append(found.count()))[0])
    got = sql_queries.join_validity(spark, str(tmp_path))
    assert got.columns == ["p_brand", "orders", "distinct_orders", "parts"] and set(map(tuple, got.collect())) == want
    assert sum(n for _, n, _, _ in want) > 60_000 and sizes[0] < 3_000
