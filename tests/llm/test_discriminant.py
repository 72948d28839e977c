"""The quality discriminant against a plain one, and its accuracy on documents it has not seen."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulmark.llm import discriminant as qda

D = len(qda.STATISTICS)


def plain_scores(train, every):
    """Textbook formulas with inverses and determinants over (statistics, label) rows."""
    x = {k: np.array([s for s, label in train if label == k], float) / qda.STEPS for k in (0, 1)}
    n = len(train)
    pooled = sum(np.cov(x[k].T, bias=True) * len(x[k]) for k in (0, 1)) / n + np.eye(D) / qda.STEPS**2
    logs = []
    for k in (0, 1):
        w = max(qda.TO_POOLED, D / (len(x[k]) + D))
        s = (1 - w) * np.cov(x[k].T, bias=True) + w * pooled
        s = (1 - qda.TO_DIAGONAL) * s + qda.TO_DIAGONAL * np.diag(np.diag(pooled))
        gap = np.array(every, float) / qda.STEPS - x[k].mean(axis=0)
        logs.append(math.log((len(x[k]) + 1) / (n + 2)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap))
    return 1 / (1 + np.exp(-(logs[1] - logs[0])))


@pytest.fixture
def labelled(spark, docs, doc_rows, tmp_path):
    rnd = random.Random(3)
    labels = [(r[0], int(rnd.random() < 0.6), 0) for r in doc_rows[:100]] + [(None, 1, 0), (3, None, 0), (500, 1, 1)]
    labels += [(7, 0, 0), (7, 1, 0), (7, 1, 1)]  # labels that differ
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("label", F.lit("x")).write.parquet(f"{tmp_path}/labels.parquet")
    docs.withColumns({c: F.lit("x") for c in ("stats", "score", "predicted", "label", "quality")}).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), labels


def test_query_equals_a_plain_discriminant(spark, labelled, doc_rows):
    folder, labels = labelled
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    votes = {}
    for i, q, _ in labels:
        if i is not None and q is not None and crc(i):
            votes.setdefault(i, []).append(q)
    truth = {i: int(2 * sum(v) >= len(v)) for i, v in votes.items()}
    stats = [qda.statistics((r[1] or "").encode()) for r in doc_rows]
    want = plain_scores([(s, truth[r[0]]) for r, s in zip(doc_rows, stats) if r[0] in truth], stats)
    got = qda.op11_quality_classifier(spark, folder).collect()
    key = lambda r: (repr(r[0]), r[2])
    want = sorted(((r[0], crc(r[0]) == 0, float(s)) for r, s in zip(doc_rows, want)), key=key)
    got_rows = sorted((tuple(r)[:3] for r in got), key=key)
    assert [r[:2] for r in got_rows] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got_rows], [r[2] for r in want], rtol=1e-6, atol=1e-9)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_model_is_the_same_for_any_partitioning(spark, docs):
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(110)], "doc_id long, label int")
    stats = qda.document_statistics(docs)
    one, many = (qda.fit(stats.repartition(k), labels) for k in (1, 23))
    for a, b in zip(one.classes, many.classes):
        assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_empty_tables_single_classes_and_long_texts(spark, docs, doc_rows, no_docs):
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert qda.quality_scores(no_docs, no_labels).count() == 0
    assert {r.score for r in qda.quality_scores(docs, no_labels).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, quality int")
    assert {r.score for r in qda.quality_scores(docs, ones).collect()} == {0.9}
    few = spark.createDataFrame([(20, 1), (21, 0)], "doc_id long, quality int")  # one row a class: the pooled covariance is zero
    got = qda.quality_scores(docs, few).collect()
    assert len(got) == len(doc_rows) and all(0 <= r.score <= 1 for r in got)
    assert len(qda.statistics(b"a " * 300_000)) == D and qda.statistics(b"") == qda.statistics(b"")


def test_accuracy_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = qda.op11_quality_classifier(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    right = np.mean([r.predicted == r.quality for r in got])
    kept = np.mean([r.predicted for r in got if r.quality == 1])
    assert len(got) > 50 and right >= 0.97 and kept >= 0.98, (right, kept)
