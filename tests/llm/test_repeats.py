"""Removed words against a table of all windows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from haulmark.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window):
    least, texts = {}, [(float("inf") if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, words in texts:
        for at in range(len(words) - window + 1):
            key = tuple(words[at:at + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for (row_id, _), (i, words) in zip(rows, texts):
        gone = {j for at in range(len(words) - window + 1) if least[tuple(words[at:at + window])] < i for j in range(at, at + window)}
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((row_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_documents(docs, doc_rows, no_docs):
    want = plain([r[:2] for r in doc_rows], 50)
    got = sorted((tuple(r) for r in repeats.without_repeats(docs).collect()), key=repr)
    assert got == want and sum(r[2] for r in want) > 500
    assert repeats.without_repeats(no_docs).count() == 0


@pytest.mark.parametrize("seed, letters, window, kmer", [(1, 2, 6, 3), (2, 3, 8, 8), (3, 3, 8, 1), (4, 40, 10, 4)])
def test_branching_and_periodic_texts(spark, seed, letters, window, kmer):
    """Few different words: windows repeat everywhere, inside documents too."""
    rnd = random.Random(seed)
    alphabet = [f"w{i}" for i in range(letters)]
    bits = [rnd.choices(alphabet, k=rnd.randint(4, 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = [w for _ in range(rnd.randint(0, 5)) for w in (rnd.choice(bits) if rnd.random() < .6 else rnd.choices(alphabet, k=9))]
        rows.append((rnd.choice([i, i, i, i // 2, None]), " ".join(words)))
    rows += [(70, "w0 " * 90), (71, "w0 " * 40 + "w1 " + "w0 " * 45), (72, "w0 w1 " * 40), (73, "w1 " + "w0 w1 " * 30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in repeats.without_repeats(frame, window, kmer).collect()), key=repr)
    assert got == plain(rows, window)
