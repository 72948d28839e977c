"""Iteration, layering, run state and dependency graphs."""

from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from haulmark.operators import graph as GR, state as ST
from haulmark import session, skew
from haulmark.rounds import Runs

EDGE = "child string, parent string, kind string"


def edges(spark, *items):
    return spark.createDataFrame([(str(c), str(p), k) for c, p, k in items], EDGE)


def nodes(spark, names, **status):
    return spark.createDataFrame([(str(n), status.get(f"n{n}", "READY")) for n in names], "name string, status string")


TEN = [(3, 1, "success"), (3, 2, "success"), (4, 3, "success"), (5, 3, "fail"), (6, 3, "complete"), (7, 4, "fail"),
       (8, 5, "success"), (9, 5, "fail"), (10, 5, "complete")]
ALL_KINDS = [(3, 1, "success"), (3, 2, "fail"), (4, 3, "success"), (5, 3, "fail"), (6, 3, "complete"), (6, 4, "complete"),
             (7, 3, "complete"), (7, 4, "complete"), (8, 5, "success"), (9, 5, "fail"), (10, 5, "complete")]


def found(df, col="name"):
    return {r[col] for r in df.collect()}


def test_leaves_and_levels(spark):
    n, e = nodes(spark, range(1, 11)), edges(spark, *TEN)
    assert found(GR.leaf_nodes(n, e)) == {"6", "7", "8", "9", "10"}
    assert {r.name: r.level for r in GR.topo_levels(n, e).collect()} == {
        "1": 1, "2": 1, "3": 2, "4": 3, "5": 3, "6": 3, "7": 4, "8": 4, "9": 4, "10": 4}
    assert found(GR.children(n, e, "fail"), "child") == {"5", "7", "9"}
    assert GR.children(n, e).count() == len(TEN)


def test_cycle(spark):
    n, e = nodes(spark, range(1, 5)), edges(spark, (2, 1, "success"), (2, 4, "success"), (3, 2, "success"), (4, 3, "success"))
    assert found(GR.find_cycles(n, e)) == {"2", "3", "4"}
    assert GR.find_cycles(n, edges(spark, (2, 1, "success"))).count() == 0


def test_dangling(spark):
    e = edges(spark, (2, 1, "success"), (2, 5, "fail"))
    assert [tuple(r) for r in GR.dangling_refs(nodes(spark, range(1, 5)), e).collect()] == [("2", "5", "fail")]


def test_runnable(spark):
    e = edges(spark, (3, 2, "success"), (4, 2, "success"), (5, 4, "success"), (6, 4, "success"), (7, 5, "success"))
    run = lambda **s: found(GR.runnable_nodes(nodes(spark, range(1, 8), **s), e))
    assert run() == {"1", "2"}
    assert run(n1="SUCCEEDED") == {"2"}
    assert run(n1="SUCCEEDED", n2="SUCCEEDED") == {"3", "4"}
    assert run(n1="SUCCEEDED", n2="SUCCEEDED", n4="SUCCEEDED") == {"3", "5", "6"}
    assert run(n1="RUNNING", n2="FAILED") == set()


def test_all_kinds(spark):
    e = edges(spark, *ALL_KINDS)
    start = nodes(spark, range(1, 11), n1="SUCCEEDED", n2="FAILED_RECOVERED", n3="FAILED_RECOVERED")
    after = {r.name: r.status for r in GR.propagate_status(start, e).collect()}
    assert {k for k, v in after.items() if v == "DEACTIVATE"} == {"4", "6", "7"}
    later = spark.createDataFrame([(k, "SUCCEEDED" if k == "5" else v) for k, v in after.items()], "name string, status string")
    done = GR.propagate_status(later, e)
    assert found(done.where("status = 'DEACTIVATE'")) == {"4", "6", "7", "9"}
    assert found(GR.runnable_nodes(done, e)) == {"8", "10"}


def test_finished_nodes_stay(spark):
    e = edges(spark, (2, 1, "fail"), (3, 2, "success"))
    out = GR.propagate_status(nodes(spark, (1, 2, 3), n1="SUCCEEDED", n2="FAILED"), e)
    assert {r.name: r.status for r in out.collect()} == {"1": "SUCCEEDED", "2": "FAILED", "3": "READY"}


def test_rollup(spark):
    r = GR.status_rollup(nodes(spark, range(4), n0="RUNNING", n1="FAILED", n2="SKIPPED", n3="DEACTIVATE")).first()
    assert r[:] == (4, 1, 1, 1, 2, 3, False)
    assert GR.status_rollup(nodes(spark, (1,), n1="SUCCEEDED")).first().has_completed


def test_splice(spark):
    sub_nodes = spark.createDataFrame([("2", "a"), ("2", "b"), ("2", "c")], "node string, name string")
    sub_edges = spark.createDataFrame([("2", "b", "a", "success"), ("2", "c", "a", "fail")], "node string, child string, parent string, kind string")
    out = GR.splice(edges(spark, (2, 1, "complete"), (3, 2, "fail")), sub_nodes, sub_edges)
    assert sorted(map(tuple, out.collect())) == sorted([
        ("2$a", "1", "complete"), ("3", "2$b", "fail"), ("3", "2$c", "fail"), ("2$b", "2$a", "success"), ("2$c", "2$a", "fail")])


def test_splice_of_hot_nodes(spark):
    """A replaced parent of 300 edges and a replaced child of 200: the same edges whatever counts as hot."""
    sub_nodes = spark.createDataFrame([(n, x) for n in ("1", "2") for x in "abc"], "node string, name string")
    sub_edges = spark.createDataFrame([(n, "b", "a", "success") for n in ("1", "2")], "node string, child string, parent string, kind string")
    rows = [(10 + i, 1, "fail") for i in range(300)] + [(2, 1000 + i, "complete") for i in range(200)] + [(2, 1, "success"), (5, 6, "fail")]
    df = edges(spark, *rows).unionByName(spark.createDataFrame([(None, "1", "fail"), ("7", None, "fail"), (None, None, "fail")], EDGE))
    first, last = {"2": ("2$a", "2$c")}, {"1": ("1$b", "1$c")}
    want = [(c, p, k) for r in df.collect() for c in first.get(r.child, (r.child,)) for p in last.get(r.parent, (r.parent,)) for k in [r.kind]]
    want += [(f"{n}$b", f"{n}$a", "success") for n in "12"]
    for floor in (skew.HOT_ROWS, 50, 1):
        assert sorted(map(tuple, GR.splice(df, sub_nodes, sub_edges, floor).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_with_many_rows_a_key_on_both_sides(spark, how):
    rows = spark.range(4000).select(F.expr("case when id % 3 = 0 then 0 when id % 7 = 0 then null else id % 50 end").alias("k"), (F.col("id") % 900).alias("v"))
    lookup = spark.range(120).select(F.expr("case when id % 10 = 0 then 0 when id % 11 = 0 then null else id % 40 end").alias("k"), F.col("id").alias("w"))
    want = sorted(map(repr, rows.join(lookup, ["k"], how).collect()))
    for floor in (300, 1, 100_000):
        assert sorted(map(repr, skew.spread_join(rows, lookup, ["k"], how, floor).collect())) == want
    empty = rows.where("k < -1")
    assert skew.spread_join(empty, lookup, ["k"], how, 1).count() == 0
    assert skew.spread_join(rows, lookup.where("k < -1"), ["k"], how, 1).count() == (4000 if how in ("left", "left_anti") else 0)


def test_spread_join_deals_the_hot_key_and_broadcasts_no_lookup(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    lookup = session.pinned(spark.range(3000).select(F.col("id").alias("k"), F.lit(1).alias("w")), "lookup")
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = [spark.conf.get(n) for n in names]
    try:
        for n, value in zip(names, ["-1", "false"]):
            spark.conf.set(n, value)
        out = skew.spread_join(rows, lookup, ["k"], "inner", 100)
        tasks = out.where("k = 0").groupBy(F.spark_partition_id()).count().collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)
    assert sum(r[1] for r in tasks) == 1500 and max(r[1] for r in tasks) < 800
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastExchange") <= 2


def test_dependency_fields(spark):
    df = spark.createDataFrame([("a", '["x", "y"]'), ("b", '{"fail": ["x"], "complete": ["y", "z"]}'), ("c", None)], "name string, d string")
    assert sorted(map(tuple, GR.parse_dependencies(df, "name", "d").collect())) == [
        ("a", "x", "success"), ("a", "y", "success"), ("b", "x", "fail"), ("b", "y", "complete"), ("b", "z", "complete")]
    with pytest.raises(Exception, match="unknown dependency field: sometimes"):
        GR.parse_dependencies(spark.createDataFrame([("a", '{"sometimes": ["x"]}')], "name string, d string"), "name", "d").collect()


def test_task_entries(spark):
    doc = '{"__defaults__": {"Component": "a", "Task": "b"}, "t1": {"Component": "a", "Task": "b"}, "t2": {"Component": "a"}, "t3": [1], "t4": "x"}'
    df = spark.createDataFrame([(1, doc)], "id int, doc string")
    assert found(GR.extract_task_nodes(df, "id", "doc")) == {"t1"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=12))
def test_levels_against_plain_python(spark, pairs):
    parents = {n: {p for c, p in pairs if c == n} for n in range(8)}
    level, changed = {}, True
    while changed:
        changed = False
        for n in range(8):
            if n not in level and all(p in level for p in parents[n]):
                level[n], changed = 1 + max((level[p] for p in parents[n]), default=0), True
    out = GR.topo_levels(nodes(spark, range(8)), edges(spark, *[(c, p, "success") for c, p in pairs]))
    assert {int(r.name): r.level for r in out.collect()} == {n: level.get(n) for n in range(8)}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skewed_joins_equal_the_join(spark, how):
    rows = spark.range(3000).selectExpr("case when id % 3 = 0 then 0 when id % 7 = 1 then null else id end as k", "id")
    lookup = spark.range(0, 3000, 2).selectExpr("id as k", "id * 2 as v")
    want = sorted(map(repr, rows.join(lookup, ["k"], how).collect()))
    assert skew.hot_keys(rows, ["k"], 100).where("k = 0").count() == 1 and skew.hot_keys(rows, ["k"], 5000) is None
    for join in (skew.salted_join(rows, lookup, ["k"], how), skew.split_hot_join(rows, lookup, ["k"], how, floor=100),
                 skew.split_hot_join(rows, lookup, ["k"], how)):
        assert sorted(map(repr, join.collect())) == want


def test_other_joins_are_refused(spark):
    for join in (skew.salted_join, skew.split_hot_join):
        with pytest.raises(ValueError):
            join(spark.range(3), spark.range(3), ["id"], "full")


def test_graph_with_a_hot_parent(spark, monkeypatch):
    """One parent has half the edges; the results are those of the plain joins."""
    n = nodes(spark, range(300), n0="FAILED_RECOVERED")
    e = edges(spark, *[(i, 0, "success") for i in range(1, 200)], *[(i, i - 100, "complete") for i in range(200, 300)])
    plain = [sorted(map(tuple, f(n, e).collect())) for f in (GR.topo_levels, GR.propagate_status, GR.runnable_nodes, GR.children, GR.dangling_refs)]
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (50,))
    monkeypatch.setattr(skew.split_hot_join, "__defaults__", ("inner", 50))
    split = [sorted(map(tuple, f(n, e).collect())) for f in (GR.topo_levels, GR.propagate_status, GR.runnable_nodes, GR.children, GR.dangling_refs)]
    assert split == plain and ("0", 1) in plain[0] and ("299", "DEACTIVATE") in plain[1]


def test_for_all_overrides(spark):
    df = spark.createDataFrame([("q", 1)], "lo string, keep int")
    out = ST.for_all(df, "step", [{"lo": "10", "hi": "20"}, {"hi": "200"}])
    assert sorted((r.iteration, r.copy_name, r.lo, r.hi, r.keep) for r in out.collect()) == [
        (1, "step$1", "10", "20", 1), (2, "step$2", "q", "200", 1)]


def test_groups(spark):
    it = ST.for_all_expr(spark, "sequence(1, 3)", "s")
    assert [tuple(r) for r in it.orderBy("iteration").collect()] == [(1, "s$1", 1), (2, "s$2", 2), (3, "s$3", 3)]
    assert sorted(map(tuple, ST.group_iterations(it, 2).collect())) == [(3, 1, "success"), (3, 2, "success")]
    assert sorted(map(tuple, ST.group_iterations(it, 1, allow_failure=True).collect())) == [(2, 1, "complete"), (3, 2, "complete")]


def test_layers_and_overlay(spark):
    df = spark.createDataFrame([("job", "a", "1"), ("context", "a", "2"), ("global", "b", "3"), ("odd", "c", "4")], "layer string, key string, value string")
    assert sorted(map(tuple, ST.layered_fallback(df, ["context", "job", "global"]).collect())) == [("a", "2", "context"), ("b", "3", "global")]
    one, two = df.select("key", "value").where("layer = 'job'"), spark.createDataFrame([("a", "9"), ("z", "8")], "key string, value string")
    assert sorted(map(tuple, ST.overlay(one, two).collect())) == [("a", "9"), ("z", "8")]
    m = spark.sql("select map('a', 1, 'b', 2) as o, map('b', 3, 'c', 4) as n").select(ST.overlay_maps("o", "n")).first()[0]
    assert m == {"a": 1, "b": 3, "c": 4}


def test_state_log(spark):
    df = spark.sql("""select * from values ('t', timestamp_ntz'2024-01-01 00:00:00', 'RUNNING'), ('t', timestamp_ntz'2024-01-01 00:01:30.5', 'RUNNING'),
        ('t', timestamp_ntz'2024-01-01 00:02:00', 'SUCCEEDED') as v(task, ts, status)""")
    r = ST.run_stats(df).first()
    assert (r.status, r.attempts, r.duration) == ("SUCCEEDED", 2, 120)
    assert ST.latest_state(df, ["task"], ["ts"]).first().status == "SUCCEEDED"
    assert ST.pending(df.select("task").distinct(), df, ["task"]).count() == 0
    assert df.select(ST.seconds_between("ts", F.lit("2024-01-01 00:00:59").cast("timestamp_ntz"))).first()[0] == 59


def written_rows(spark, folder, *labels):
    return sum(spark.read.parquet(str(p)).count() for p in folder.iterdir() if p.name.split("-")[0] in labels)


def test_long_chains_are_climbed(spark, tmp_path, monkeypatch):
    """10,000 nodes in a row and a fan at the end: a logarithm of rounds, n log n rows written."""
    n = 10_000
    chain = [(f"c{i}", f"c{i - 1}") for i in range(1, n)] + [(f"f{i}", f"c{n - 1}") for i in range(40)]
    nodes = spark.createDataFrame([("c0",)] + [(c,) for c, _ in chain], "name string")
    edges = spark.createDataFrame([(c, p, "success") for c, p in chain], "child string, parent string, kind string")
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    levels = {r.name: r.level for r in GR.topo_levels(nodes, edges).collect()}
    assert levels == {f"c{i}": i + 1 for i in range(n)} | {f"f{i}": n + 1 for i in range(40)}
    rounds = [p for d in tmp_path.iterdir() if d.name.startswith(("climb-", "levels-")) for p in d.iterdir() if p.name.startswith("round=")]
    assert len(rounds) <= 18
    assert written_rows(spark, tmp_path, "climb", "levels", "waiting") <= 16 * len(levels)


def test_long_chains_pass_deactivation_on(spark, tmp_path, monkeypatch):
    n = 500
    chain = [(f"c{i}", f"c{i - 1}") for i in range(1, n)]
    status = {"c0": "FAILED_RECOVERED", "c400": "SUCCEEDED"}
    nodes = spark.createDataFrame([(f"c{i}", status.get(f"c{i}", "READY")) for i in range(n)], "name string, status string")
    edges = spark.createDataFrame([(c, p, "success") for c, p in chain], "child string, parent string, kind string")
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    out = {r.name: r.status for r in GR.propagate_status(nodes, edges).collect()}
    assert out == {f"c{i}": status.get(f"c{i}", "DEACTIVATE" if i < 400 else "READY") for i in range(n)}
    assert len([p for d in tmp_path.iterdir() if d.name.startswith(("climb-", "deactivated-")) for p in d.iterdir() if p.name.startswith("round=")]) <= 13


def test_ladders_take_a_round_a_rung(spark, tmp_path, monkeypatch):
    """Every rung has two parents, one of them at the end of a chain: nothing but rungs is left for the rounds."""
    rungs = 5
    pairs = [x for i in range(1, rungs) for x in ((f"r{i}", f"r{i - 1}"), (f"a{i}", f"r{i - 1}"), (f"b{i}", f"a{i}"), (f"r{i}", f"b{i}"))]
    names = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([(x,) for x in names], "name string")
    edges = spark.createDataFrame([(c, p, "success") for c, p in pairs], "child string, parent string, kind string")
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    levels = {r.name: r.level for r in GR.topo_levels(nodes, edges).collect()}
    assert levels == {f"{x}{i}": 3 * i + 1 - {"r": 0, "b": 1, "a": 2}[x] for x in "rab" for i in range(x != "r", rungs)}
    assert written_rows(spark, tmp_path, "waiting") <= 3 * rungs


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.sampled_from(GR.KINDS)), max_size=12),
       st.lists(st.sampled_from(["READY", "RUNNING", "SUCCEEDED", "FAILED_RECOVERED", "FAILED", "DEACTIVATE"]), min_size=8, max_size=8))
def test_deactivation_against_plain_python(spark, arcs, statuses):
    want, changed = list(statuses), True
    while changed:
        changed = False
        for c, p, kind in arcs:
            kills = want[p] == "DEACTIVATE" or (want[p] == "FAILED_RECOVERED" and kind == "success") or (want[p] == "SUCCEEDED" and kind == "fail")
            if kills and want[c] in ("READY", "RUNNING"):
                want[c], changed = "DEACTIVATE", True
    out = GR.propagate_status(spark.createDataFrame([(str(i), s) for i, s in enumerate(statuses)], "name string, status string"),
                              edges(spark, *arcs))
    assert [s for _, s in sorted((int(r.name), r.status) for r in out.collect())] == want


def test_levels_of_odd_names(spark):
    """NULL names and parents, self-reference, repeated edges, children that are no nodes, empty tables."""
    nodes = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("s",), ("d",), (None,)], "name string")
    edges = spark.createDataFrame([("b", "a", "success"), ("b", "a", "fail"), ("c", None, "success"), ("s", "s", "success"), ("d", "zz", "success"),
                                   ("zz", "a", "success"), (None, "a", "success")], "child string, parent string, kind string")
    assert sorted(map(repr, map(tuple, GR.topo_levels(nodes, edges).collect()))) == sorted(
        map(repr, [("a", 1), ("b", 2), ("c", None), ("s", None), ("d", None), (None, None)]))
    assert GR.topo_levels(nodes.where("false"), edges).collect() == []
    assert {r.name: r.level for r in GR.topo_levels(nodes, edges.where("false"), 1).collect()} == {"a": 1, "b": 1, "c": 1, "s": 1, "d": 1, None: None}


def test_runs_stay_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    runs = Runs("some", lambda df: df)
    for i in range(11):
        runs.add(spark.range(i, i + 1))
    assert [rank for rank, _ in runs.tables] == [3, 1, 0]
    assert sorted(r.id for r in runs.rows().collect()) == list(range(11))
