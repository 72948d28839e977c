"""The Merkle manifest against a plain tree built row by row."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from haulmark.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(hashes, fanout):
    """The last node, and of each leaf the (before, after) of its levels."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[i:i + fanout] for i in range(0, len(hashes), fanout)]
        for path, i in zip(paths, at):
            path.append(("".join(runs[i // fanout][:i % fanout]), "".join(runs[i // fanout][i % fanout + 1:])))
        at, hashes = [i // fanout for i in at], [sha(*run) for run in runs]
    return hashes[0], paths


def plain_manifest(rows, fanout):
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        lower = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        leaf, altered = (sha(*map(framed, (doc_id, source, lang, n_chars, t))) for t in (text, lower))
        crc = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        by_source[source].append((doc_id, leaf, altered if crc % 5 == 0 else leaf))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = plain_tree([leaf for _, leaf, _ in by_source[s]], fanout)
    root, tops = plain_tree([trees[s][0] for s in sources], fanout)
    out = []
    for s, top in zip(sources, tops):
        for (doc_id, leaf, used), path in zip(by_source[s], trees[s][1]):
            folded = used
            for before, after in path + top:
                folded = sha(before, folded, after)
            out.append((doc_id, leaf, trees[s][0], root, sha(*(x for step in path + top for x in step)), folded, folded == root))
    return sorted(out, key=repr)


def got(df, fanout):
    return sorted((tuple(r) for r in merkle.manifest(df, fanout).collect()), key=repr)


@pytest.mark.parametrize("fanout", [2, 16])
def test_manifest_equals_a_plain_tree(docs, doc_rows, fanout):
    rows = [(r[0], None if r[1] is None else r[1].replace("ka", "Ka"), *r[2:]) for r in doc_rows]
    docs = docs.withColumn("text", F.replace("text", F.lit("ka"), F.lit("Ka")))
    clashing = docs.withColumns({c: F.lit(0) for c in ("leaf", "root", "hash", "pos", "n", "path", "slot0", "_at", "altered")})
    found = got(clashing, fanout)
    assert found == plain_manifest(rows, fanout)
    assert {r[-1] for r in found} == {True, False}


def test_one_row_one_source_and_no_rows(spark, no_docs):
    lone = [(5, "A b", "en", "s", 3)]
    schema = no_docs.schema
    assert got(spark.createDataFrame(lone, schema), 16) == plain_manifest(lone, 16)
    one = [(i % 40, f"Text {i % 23}", None, None, i % 23) for i in range(70)]  # repeated ids, some rows wholly repeated
    assert got(spark.createDataFrame(one, schema), 4) == plain_manifest(one, 4)
    many = [(i, "X", "en", f"s{i:03}é", i) for i in range(40)]  # sources of one row, a tree of subroots
    assert got(spark.createDataFrame(many, schema), 16) == plain_manifest(many, 16)
    assert got(no_docs, 16) == []
