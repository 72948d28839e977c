"""The forward pass against all segmentations, and held-out accuracy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from haulmark.llm import language
from haulmark.llm.language import MARK, Pieces


def segmentations(word):
    if not word:
        yield ()
    for i in range(1, len(word) + 1):
        for rest in segmentations(word[i:]):
            yield (word[:i], *rest)


@pytest.mark.parametrize("word", ["a", "the", "enheit", "漢x", "qqq", "ünder"])
def test_forward_sums_all_segmentations(word):
    pieces, rnd = Pieces.of(language.VOCABULARY), np.random.default_rng(4)
    logs = np.log(rnd.dirichlet(np.ones(pieces.size), 2).T)
    want = np.zeros(2)
    uses = np.zeros(pieces.size)
    for parts in segmentations(MARK + word):
        ids = [pieces.ids.get(p, pieces.unk if len(p) == 1 else None) for p in parts]
        if None not in ids:
            p = np.exp(logs[ids].sum(axis=0))
            want += p
            for i in ids:
                uses[i] += p[0]
    got = language.word_scores([word, "other"], language._with_none(logs), pieces)[0]
    assert got == pytest.approx(np.log(want))
    expected = language.expected_pieces([word], np.array([3.0]), language._with_none(logs[:, :1]), pieces)
    assert expected == pytest.approx(3 * uses / want[0], abs=1e-12)


def test_long_words_and_letters():
    pieces = Pieces.of(language.VOCABULARY)
    logs = language._with_none(np.full((pieces.size, 1), -math.log(pieces.size)))
    assert np.isfinite(language.word_scores(["x" * 5000], logs, pieces)).all()
    assert language.letter_runs("It's 4x²! Ü") == ["it", "s", "x²", "ü"] and language.letter_runs("² 12 _") == []


def test_held_out_accuracy_and_defined_cases(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("extra"))
    odd = spark.createDataFrame([(100001, None), (100002, "12 34 !"), (100003, ""), (None, "the and of the and"), (100004, "q" * 40_000)],
                                "doc_id long, text string").withColumns(
        {"lang": F.lit(None).cast("string"), "source": F.lit("x"), "n_chars": F.lit(1).cast("long"), "score": F.lit("x")})
    got = language.predict_held_out(docs.unionByName(odd).unionByName(odd)).join(
        docs.select(F.col("doc_id").alias("id"), "lang"), F.col("doc_id") == F.col("id"), "left").collect()
    assert len(got) == 1010
    rated = [r for r in got if r.held_out and r.id is not None]
    assert len(rated) > 200 and sum(r.lang_pred == r.lang for r in rated) >= 0.97 * len(rated)
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (__import__("zlib").crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1)
        if r.doc_id in (100001, 100002, 100003):
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_nothing_to_learn(docs, no_docs):
    assert language.predict_held_out(no_docs).count() == 0
    from pyspark.sql import functions as F
    got = language.predict_held_out(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in got] == ["und"]
