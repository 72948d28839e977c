"""Fingerprints and components against plain versions, also in crowded groups."""

from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from haulmark.llm import simhash
from haulmark.llm.components import components, contraction


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((1 << b) for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, prints):
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for i, p in zip(ids, prints):
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return [least.get(root(p)) for p in prints]


def test_components_of_documents(docs, doc_rows, no_docs):
    prints = [plain_print(r[1]) for r in doc_rows]
    want = sorted(zip([r[0] for r in doc_rows], [f"{p:016x}" for p in prints], plain_components([r[0] for r in doc_rows], prints)), key=repr)
    assert sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=repr) == want
    assert simhash.simhash_components(no_docs).count() == 0
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({w[2] for w in want}, key=repr)
    assert simhash.without_near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("loose", [3, 9, 14])
def test_crowded_groups_lose_no_connection(spark, loose):
    """Many fingerprints that differ from one in some of a few loose bits, with chains between groups."""
    rnd = random.Random(loose)
    prints = []
    for _ in range(3):
        base, bits = rnd.getrandbits(64), rnd.sample(range(64), loose)
        prints += [base ^ sum(1 << b for b in bits if rnd.random() < 0.35) for _ in range(250)]
    chain = rnd.getrandbits(64)
    for _ in range(40):
        prints.append(chain)
        for b in rnd.sample(range(64), 4):
            chain ^= 1 << b
    prints += [0, 1, 31, 63, (1 << 64) - 1]
    rnd.shuffle(prints)
    frame = spark.createDataFrame([(i, simhash.signed(p)) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.near_duplicates(frame).collect()}
    want = plain_components(range(len(prints)), prints)
    assert [got[simhash.signed(p)] for p in prints] == want
    for bands in {3: (), 9: (8,), 14: (7,)}[loose]:
        more = simhash.near_links(frame.select("fp").distinct(), bands=bands)
        roots = {r.node: r.root for r in components(more).collect()}
        by_root, by_want = {}, {}
        for p, w in zip(prints, want):
            p = simhash.signed(p)
            by_root.setdefault(roots.get(p, ("alone", p)), set()).add(p)
            by_want.setdefault(w, set()).add(p)
        assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_want.values()))
    links = simhash.near_links(frame.select("fp").distinct()).count()
    assert links <= 15 * simhash.LEADERS * len(set(prints))  # not their square


def test_listed_fingerprints_are_not_broadcast(spark):
    """Each is listed under 15 keys; sized as one row, too many of them would fit into a broadcast."""
    rnd = random.Random(1)
    prints = [simhash.signed(rnd.getrandbits(64)) for _ in range(2_000)]
    prints += [p ^ 1 for p in prints[:5]]
    found = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    assert {frozenset(r) for r in found.collect()} == {frozenset((p, p ^ 1)) for p in prints[:5]}
    meets = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "x.before" not in x and "bit_count" in x]
    assert meets and all("SortMergeJoin" in x for x in meets), meets


def test_bands_grow_with_the_corpus():
    assert [simhash.bands_for(n) for n in (0, 10**8, 10**9, 5 * 10**10)] == [6, 6, 7, 8]
    assert [len(simhash._keys(b, b - 4)) for b in (6, 7, 8)] == [15, 35, 70]


def test_a_sorted_chain_takes_few_rounds(spark):
    chain = spark.range(10_000).selectExpr("id as a", "id + 1 as b")
    rounds = contraction(chain)
    assert len(rounds) <= 25
    sizes = [r.count() for r in rounds]
    assert all(b < 0.8 * a for a, b in zip(sizes, sizes[1:]) if a > 100), sizes
    roots = components(chain)
    assert roots.count() == 10_001 and roots.select("root").distinct().count() == 1
    assert roots._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_contraction_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000), (7, 3), (3, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == 301 + 200 and len({got[i] for i in range(301)}) == 1 and len({got[i] for i in range(1000, 1200)}) == 1
    assert got[0] != got[1000]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
