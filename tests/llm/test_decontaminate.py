"""Alignment against the textbook matrix, and planted copies in documents."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings, strategies as st

from haulmark.llm import decontaminate as d


def matrix_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), min_size=1, max_size=12), st.lists(st.sampled_from("abcdez"), max_size=25))
def test_alignment_scores(a, b):
    score, start, end = d.align(a, b)
    assert score == matrix_score(a, b) == matrix_score(a, b[start:end])


def test_planted_copies_are_found_and_clean_ones_left(spark, docs, no_docs):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 7)))
    common = [word() for _ in range(30)]
    say = lambda k: [rnd.choice(common) if rnd.random() < .4 else word() for _ in range(k)]
    items = [(i, " ".join(say(rnd.randint(15, 50)))) for i in range(20)] + [(20, None), (21, ""), (22, "Only three words"), (3, "x y"), (0, "!")]
    edited = lambda t, p: " ".join(w if rnd.random() > p else word() for w in t.split())
    rows, planted = [], {}
    for i in range(400):
        text = " ".join(say(rnd.randint(5, 200)))
        if i % 10 == 0:
            item, body = items[rnd.randrange(20)]
            text = " ".join(say(60)) + " " + edited(body, 0.15 if i % 20 else 0).replace(" ", ", ").upper() + " " + " ".join(say(90))
            planted[i] = str(item)
        if i % 3 == 1:  # one item in a third of all documents
            text = " ".join(say(10)) + ".\n" + items[5][1] + " " + " ".join(say(8))
            planted[i] = "5"
        rows.append((i, text, "en", "s", 1))
    rows[7] = (7, "w " * 30_000 + items[6][1], "en", "s", 1)
    planted[7] = "6"
    rows[9] = (9, "here Only, three WORDS stand", "en", "s", 1)
    planted[9] = "22"
    rows += [(401, None, None, None, None), (402, "", "en", "s", 0), (None, items[2][1], "en", "s", 1), rows[20], rows[20]]
    planted[None] = "2"
    frame = spark.createDataFrame(rows, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.contaminated(frame, bench).collect()
    assert {r.doc_id: r.item_id for r in got} == planted and len(got) == len(planted)
    kept = d.without_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows if r[0] not in planted)
    assert d.contaminated(no_docs, bench).count() == 0
    assert d.contaminated(frame, bench.limit(0)).count() == 0
    assert d.without_contaminated(frame, bench.limit(0)).count() == len(rows)


def test_blocks_of_seeds_change_nothing(spark, docs, monkeypatch):
    bench = docs.where("doc_id in (3, 30, 50)").selectExpr("doc_id as item_id", "text")
    want = sorted(map(tuple, d.contaminated(docs, bench).collect()), key=repr)
    monkeypatch.setattr(d, "SEED_BLOCK", 50)
    assert sorted(map(tuple, d.contaminated(docs, bench).collect()), key=repr) == want and want


def test_partial_passages_of_long_items_and_short_phrases(spark):
    """Long items by an absolute passage; short ones neither by a lone seed nor only by an entire match."""
    w = lambda name, n: [f"{name}{i}" for i in range(n)]
    long_, longer, nine, seven, six, five = w("a", 59), w("b", 200), w("c", 9), w("d", 7), w("e", 6), w("f", 5)
    items = list(enumerate(map(" ".join, (long_, longer, nine, seven, six, five))))
    texts = {
        "23 of 59 words": (long_[20:43], 0), "70 of 200": (longer[100:170], 1), "13 of 200": (longer[43:56], 1), "12 of 200": (longer[43:55], None),
        "4 of 9": (nine[3:7], None), "4 of 9, rarer": (nine[:4], None), "9 with one edit": (nine[:4] + ["odd"] + nine[5:], 2),
        "7 with one edit": (seven[:3] + ["odd"] + seven[4:], 3), "7 with one word less": (seven[:3] + seven[4:], 3), "4 of 7": (seven[2:6], None),
        "6 with one edit": (six[:2] + ["odd"] + six[3:], 4), "3 of 6": (six[2:5], None), "5": (five, 5), "4 of 5": (five[:4], None)}
    rows = [(i, " ".join(w(f"x{i}y", 30) + t + w(f"z{i}y", 30))) for i, (t, _) in enumerate(texts.values())]
    got = d.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    names = list(texts)
    assert {names[r.doc_id]: int(r.item_id) for r in got} == {k: v for k, (_, v) in texts.items() if v is not None}


def test_every_long_passage_keeps_a_seed(spark):
    """Also in the commoner part of an item, where no seed is rare."""
    item = [f"a{i}" for i in range(60)]
    rows = [(0, " ".join(item[:13]))] + [(i, " ".join(item[:30])) for i in range(1, 40)] + [(99, " ".join(item[40:44]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    seeds = d.item_seeds(spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    counts = d._count_words(frame, "text", d._hashes(seeds.selectExpr("explode(parts) as seed")))
    rare = {r.seed for r in d.rare_seeds(seeds, counts, 1).collect()}
    places = d.Windows().of(d.WordHashes().of([x.encode() for x in item]), d.SEED) ^ d.np.uint64(d.SEED)
    kept = [x in rare for x in places.view(d.np.int64).tolist()]
    assert all(any(kept[at:at + 10]) for at in range(len(kept) - 9))


def test_edited_copies_against_alignment_of_all_pairs(spark):
    """Copies with evenly spaced and with random edits: what the aligner accepts in any pair is found, and nothing else."""
    rnd = random.Random(21)
    vocab = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 8))) for _ in range(3000)]
    say = lambda k: rnd.choices(vocab, [1 / (r + 3) for r in range(len(vocab))], k=k)
    items = [say(rnd.randint(12, 60)) for _ in range(40)]
    rates = {"10%": 10, "20%": 5, "25%": 4, "33%": 3}
    rows, rate_of = [], {}
    for rate, step in rates.items():
        for i in range(60):
            body = items[rnd.randrange(40)]
            at = {k for k in range(len(body)) if (k % step == step - 1 if i % 2 else rnd.random() < 1 / step)}
            rate_of[len(rows)] = rate
            rows.append((len(rows), " ".join(say(20) + [rnd.choice(vocab) if k in at else w for k, w in enumerate(body)] + say(25))))
    rows += [(len(rows) + i, " ".join(say(80))) for i in range(60)]
    want = {}
    for doc, text in rows:
        words = text.encode().split()
        for i, body in enumerate(items):
            score = d.align([w.encode() for w in body], words)[0]
            if score >= d.least_score(len(body)):
                want[doc, str(i)] = score / (2 * len(body))
    got = {(r.doc_id, r.item_id): r.share for r in d.contaminated(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
        spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()}
    assert got.items() <= want.items()
    for rate in rates:
        mine = [p for p in want if rate_of.get(p[0]) == rate]
        recall = sum(p in got for p in mine) / len(mine)
        print(f"edits {rate}: {len(mine)} pairs accepted, recall {recall:.3f}")
        assert len(mine) >= 50 and recall >= 0.97


def test_other_columns_are_not_looked_at(spark, docs):
    bench = docs.where("doc_id in (3, 30, 50)").selectExpr("doc_id as item_id", "text")
    want = sorted(map(tuple, d.contaminated(docs, bench).collect()), key=repr)
    clash = docs.selectExpr("*", "1 as start", "2 as passage", "'x' as item_id", "3 as share", "4 as seed", "5 as _mark")
    assert sorted(map(tuple, d.contaminated(clash, bench.selectExpr("*", "7 as n", "'y' as words", "8 as doc_id")).collect()), key=repr) == want
    kept = d.without_contaminated(clash, bench)
    assert kept.columns == clash.columns and kept.count() == docs.count() - len({(r[0]) for r in want}) - sum(
        docs.where(f"doc_id = {r[0]}").count() - 1 for r in {r[:1] for r in want if r[0] is not None})
