"""Gradients by differences, windows against one long pass, base scores against plain counts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from haulmark.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def vocabulary():
    return lm.Vocabulary(np.random.default_rng(1).zipf(1.3, lm.END + 1).clip(0, 10_000) * (np.arange(lm.END + 1) < 9000))


def test_gradients(vocabulary):
    rnd = np.random.default_rng(2)
    p = {n: x.astype(np.float64) for n, x in lm.first_parameters(vocabulary).items()}
    rows, targets = lm.windows_of([rnd.integers(0, 9000, n) for n in (1, 40, 90)], vocabulary)
    classes = np.where(targets >= 0, vocabulary.class_of[np.maximum(targets, 0)], -1)
    g, _ = lm.gradients(p, rows, classes)
    for name in p:
        flat = p[name].reshape(-1)
        for i in rnd.choice(np.flatnonzero(g[name].ravel()), 6):
            was, h = flat[i], 1e-4
            flat[i] = was + h
            up = lm.gradients(p, rows, classes)[1]
            flat[i] = was - h
            down = lm.gradients(p, rows, classes)[1]
            flat[i] = was
            assert g[name].ravel()[i] == pytest.approx((up - down) / (2 * h), rel=1e-2, abs=1e-5), name


@pytest.mark.parametrize("times", [1, 3000])
def test_gradients_by_graph(vocabulary, times):
    """The graph's gradients are those of numpy, where exponentials leave the range of floats too."""
    rnd = np.random.default_rng(4)
    p = lm.first_parameters(vocabulary)
    p |= {"b": rnd.standard_normal(2 * lm.HALF).astype(np.float32), "q": p["q"] * times}
    rows, classes = lm.stretches_of([rnd.integers(0, 9000, n) for n in (1, 31, 32, 33, 700, 5)], vocabulary)
    for pick in (slice(None), slice(1), slice(len(rows) - 1, None)):
        want, got = lm.gradients(p, rows[pick], classes[pick])[0], lm.quick_gradients(p, rows[pick], classes[pick])
        assert want.keys() == got.keys()
        for name in want:
            assert got[name].dtype == np.float32 and np.abs(got[name] - want[name]).max() <= 1e-5 * np.abs(want[name]).max(), name


def test_a_text_scores_alike_in_any_batch(vocabulary):
    rnd = np.random.default_rng(6)
    p = lm.first_parameters(vocabulary)
    texts = [rnd.integers(0, 9000, n) for n in (1, 31, 32, 33, 64, 65, 200, 3000)]
    alone = np.concatenate([lm.log_probabilities(p, vocabulary, [t]) for t in texts])
    for batch in (1, 7, 64):
        assert lm.log_probabilities(p, vocabulary, texts, batch).tolist() == alone.tolist()


def plain_score(p, vocabulary, ids):
    """Each id from a loop over its own window."""
    rows = [lm.Vocabulary.START, *vocabulary.row_of[ids[:-1]]]
    total = 0.0
    for t, target in enumerate(ids):
        low = max(0, t // lm.HALF * lm.HALF - lm.HALF)
        e = p["e"][rows[low:t + 1]].astype(float)
        s = e[-1] @ p["q"] @ (e @ p["k"]).T / math.sqrt(lm.WIDTH) + p["b"][np.arange(t - low, -1, -1)]
        a = np.exp(s - s.max())
        logits = ((a / a.sum()) @ (e @ p["v"]) + e[-1]) @ p["o"] + p["c"]
        total += logits[vocabulary.class_of[target]] - np.log(np.exp(logits).sum()) + vocabulary.inside[target]
    return total


def test_windows_score_each_id_once_and_probabilities_sum_to_one(vocabulary):
    rnd = np.random.default_rng(3)
    p = lm.first_parameters(vocabulary)
    p["b"] = rnd.standard_normal(2 * lm.HALF).astype(np.float32)
    texts = [rnd.integers(0, 9000, n) for n in (1, 31, 32, 33, 64, 65, 200)]
    for _, targets in (lm.windows_of(texts, vocabulary), lm.halves_of(texts, vocabulary)[:2]):
        assert (targets >= 0).sum() == sum(map(len, texts))
    want = [plain_score(p, vocabulary, t) for t in texts]
    for batch in (1, 3, 64):
        assert lm.log_probabilities(p, vocabulary, texts, batch) == pytest.approx(want, rel=1e-4)
    large = p | {"q": p["q"] * 3000, "o": p["o"] * 300}  # out of the range where exponentials are taken as they are
    assert lm.log_probabilities(large, vocabulary, texts) == pytest.approx([plain_score(large, vocabulary, t) for t in texts], rel=1e-3)
    assert np.bincount(vocabulary.class_of, np.exp(vocabulary.inside.astype(float)), lm.CLASSES) == pytest.approx(
        (np.bincount(vocabulary.class_of, minlength=lm.CLASSES) > 0).astype(float), abs=1e-3)


def check_base(got, rows):
    tokens = {i: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, (_, t) in enumerate(rows)}
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d, held[i], len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(
        math.log10((counts[w] + .1) / (n + .1 * (v + 1))) for w in ws), 6)) for i, (d, _) in enumerate(rows) for ws in [tokens[i]]), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want


@pytest.mark.parametrize("head", [1 << 18, 40, 0])
def test_base_scores(docs, doc_rows, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    got = lm.lm_scores(docs).collect()
    check_base(got, [r[:2] for r in doc_rows])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert len({r.score for r in got if r.doc_id == 30}) == 1


def test_empty_tables(spark, no_docs):
    assert lm.lm_scores(no_docs).count() == 0


def test_attention_learns(spark):
    """On held-out documents the trained model beats the frequencies of classes, and unseen words cost less than in the base."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.lm_scores(docs).where("held_out and n_tokens > 50").collect()
    bodies = {r.doc_id: r.text for r in docs.collect()}
    reader = lm.Reader()
    ids = np.concatenate([reader.ids(reader.words(bodies[r.doc_id].encode())) for r in rows])
    counts = np.bincount(ids, minlength=lm.END + 1)  # even against their own frequencies
    unigram = float((np.log10((counts + .5) / (counts + .5).sum())[ids]).sum())
    assert sum(r.score for r in rows) > unigram


def test_every_training_document_is_used(spark):
    """Each document has words of its own; training must move the input row of every id it reads."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q {chr(97 + i // 26)}{chr(97 + i % 26)}zx end") for i in range(300)] + [(None, "null id")]
    reader = lm.Reader()
    ids = [reader.ids(reader.words(t.encode())) for _, t in rows]
    vocabulary = lm.Vocabulary(np.bincount(np.concatenate(ids), minlength=lm.END + 1))
    p = lm.train_attention(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), vocabulary)
    moved = (p["e"] != lm.first_parameters(vocabulary)["e"]).any(axis=1)
    read = np.unique(vocabulary.row_of[np.concatenate([x[:-1] for x in ids])])
    assert len(read) > 200 and moved[read].all()


def test_words_come_back_from_ids():
    """Hashes made from ids tell words apart as their bytes do, whatever the words hold and wherever they stand."""
    rnd = np.random.default_rng(5)
    odd = ["<|endoftext|>", "a<|endoftext|>b", "　x", "\xa0", "x y", "don't", "ß", "日本", "Ġ", "Ġa", "a", "aa", "...", "1234", "\x00", "'s"]
    words = [w.encode() for w in odd] + [b"\xff", b"\xff\xfe", b"\xfe\xff", b"a\xff", b"\xef\xbf\xbd", b"a\xef\xbf\xbd", b"x" * 5000]
    words += [bytes(rnd.integers(33, 256, int(n)).astype(np.uint8)) for n in rnd.integers(1, 9, 300)]
    texts = [[words[i] for i in rnd.integers(0, len(words), n)] for n in (0, 1, 50, 2000)]
    reader = lm.Reader()
    split = [reader.words(b" ".join(t)) for t in texts]
    hashes, cut = reader.word_hashes([reader.unpacked(reader.packed(b"\t".join(t) + b" \n")) for t in texts])
    flat = [w for t in split for w in (*t, None)]
    assert np.diff(cut).tolist() == [len(t) + 1 for t in split] and len(flat) == len(hashes)
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_texts_encoded_at_once_are_those_encoded_by_word():
    bodies = [None, b"", b" ", b"  A b\t\nB\x0bc\x0cd\re ", b"\xff\xfe A \xff\xfe", "Äß　x\xa0y \x85z\x1cq Ä".encode(), b"a\x00b \x00 it's, the the THE", b"x" * 5000]
    reader = lm.Reader()
    want = [b"".join(reader[w] for w in reader.words(b)) + reader.encoder.value([lm.END]) for b in bodies]
    column = pa.array([b"before", *bodies, None], pa.binary())
    assert reader.packed_texts(column[1:-1]) == want and [reader.packed(b) for b in bodies] == want
    assert reader.packed_texts(column[:0]) == []
