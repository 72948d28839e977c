"""Mixing against its SQL and against rounds of clamping."""

from __future__ import annotations

import random

import duckdb
import pytest

from haulmark.llm import mixing
from tools.check_queries import rows_of


def rounds(sizes, weights, times=3):
    """Water-filling as it is told: clamp, share the excess again, until none is above."""
    total, cap = sum(sizes), [times * s for s in sizes]
    full: set[int] = set()
    while True:
        left, weight = total - sum(cap[i] for i in full), sum(w for i, w in enumerate(weights) if i not in full)
        out = [cap[i] if i in full else left * w / weight for i, w in enumerate(weights)]
        above = {i for i in range(len(sizes)) if i not in full and out[i] > cap[i]}
        if not above:
            return out
        full |= above


@pytest.mark.parametrize("sizes", [[10, 1000, 3], [5], [0, 0], [1, 1, 1, 1, 500, 2, 0], [7] * 9])
def test_levels_are_those_of_the_rounds(spark, sizes):
    frame = spark.createDataFrame([(f"s{i:02d}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(mixing.cyclic_weights(frame)).collect()}
    want = rounds(sizes, [i % 3 + 1 for i in range(len(sizes))])
    assert [got[f"s{i:02d}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mix_equals_its_sql(docs, no_docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    rel = con.execute(mixing.MIX_SQL)
    names, want = [d[0] for d in rel.description], rel.fetchall()
    got = mixing.mix(docs)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want)
    assert mixing.mix(no_docs).count() == 0
    copies = {}
    for r in got.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in made.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in copies.items() if v}
    assert mixing.mixed_documents(no_docs).count() == 0


def test_taken_words_come_near_their_targets(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randint(1, 60), "hot" if i % 3 == 0 else f"s{i % 10}") for i in range(5000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    for r in got.groupBy("source").agg({"taken": "sum", "target": "max", "size": "max", "copies": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 60 and r["max(copies)"] <= 3
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(3))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_only_native_operations(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_that_share_an_id_are_drawn_apart(spark):
    """Null ids with texts of their own are no block: the taken words come near the target."""
    rows = [(None, f"word{i} and more of it", "a", i) for i in range(3000)] + [(i, "one two three four", "b", 0) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 4, r
