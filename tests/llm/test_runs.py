"""Periodic runs against plain searches."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from haulmark.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def plain_runs(w, least=6, periods=4):
    """Every stretch with a period that no neighbour extends, if no smaller period holds."""
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, periods * q) and smallest_period(w[i:j + q]) == q:
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_lyndon(w):
    """The longest word at each place that is smaller than all its proper suffixes."""
    is_lyndon = lambda x: all(x < x[k:] for k in range(1, len(x)))
    return [max(j - i for j in range(i + 1, len(w) + 1) if is_lyndon(w[i:j])) for i in range(len(w))]


words = st.lists(st.integers(0, 2), max_size=14)
periodic = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 7)), max_size=6).map(
    lambda parts: [x for unit, times in parts for x in unit * times])


@settings(max_examples=300, deadline=None)
@given(words)
def test_grouping_gives_the_lyndon_array(w):
    if w:
        ranks = np.unique(w, return_inverse=True)[1].tolist()
        assert runs.lyndon_lengths(ranks) == plain_lyndon(ranks)


@settings(max_examples=300, deadline=None)
@given(periodic)
def test_runs_of_one_text(w):
    for least, periods in ((6, 4), (2, 2), (3, 3)):
        want = [(s, s + n, q) for s, n, q in plain_runs(w, least, periods)]
        assert runs.runs_of(np.array(w, np.int64), least, periods) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(periodic, max_size=5))
def test_runs_of_many_texts_at_once(texts):
    got = runs.runs_in([np.array(t, np.int64) for t in texts])
    assert got == [plain_runs(t) for t in texts]


def test_strings_that_defeat_power_of_two_hashes():
    thue = [bin(i).count("1") % 2 for i in range(4096)]  # no cubes, and the trap of hashes modulo 2**64
    assert runs.runs_of(np.array(thue, np.int64)) == []
    w = np.array(thue[:700] * 5 + [7] * 9, np.int64)
    assert runs.runs_of(w) == [(0, 3500, 700), (3500, 3509, 1)]
    assert runs.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = plain_runs(w) if n < 2000 else [(s, e - s, q) for s, e, q in runs.runs_of(np.unique(w, return_inverse=True)[1])]
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = (None,) * 4
    for s, size, q in found:
        if best[0] is None or size * best[2] > best[1] * q:
            best = (s, size, q, 1000 * size // q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.fixture
def folder(docs, tmp_path):
    docs.withColumns({c: F.lit("extra") for c in ("starts", "lengths", "periods", "runs", "best", "collapsed", "_planted", "_text")}) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_query_equals_plain_search(spark, folder, doc_rows):
    got = sorted((tuple(r) for r in runs.op13_periodic_runs(spark, folder).collect()), key=repr)
    assert got == sorted((plain_row(r[0], r[1]) for r in doc_rows), key=repr)
    assert sum(r[1] > 0 for r in got) >= 3


def test_operator_gives_runs_and_texts(spark, no_docs):
    rows = [(1, "a b a b a b a b c"), (2, None), (3, ""), (3, "x x x x x"), (None, "y " * 9), (4, "one two " * 40_000)]
    got = {r.doc_id: r for r in runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_words}
    assert (got[1].starts, got[1].lengths, got[1].periods, bytes(got[1].collapsed)) == ([0], [8], [2], b"a b c")
    assert got[3].starts == [] and bytes(got[3].collapsed) == b"x x x x x"
    assert (got[None].lengths, bytes(got[None].collapsed)) == ([9], b"y")
    assert (got[4].lengths, got[4].periods, bytes(got[4].collapsed)) == ([80_000], [2], b"one two")
    assert runs.periodic_runs(no_docs).count() == 0
