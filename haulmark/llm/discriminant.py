"""Quality scores by a regularised quadratic discriminant over document statistics.

Each text becomes ``STATISTICS``: lengths as logarithms, shares as log-odds, so that a class is nearer to a normal distribution.
Each class has its mean and its covariance, shrunk towards the covariance of all classes together (the fewer its rows, the
more) and that towards its diagonal. A score is the logistic of the difference of the classes' log densities, whose
Mahalanobis distances come from Cholesky factors that are made once and travel with the model, and of the log of their shares.

Statistics are rounded to 1/1024, so that sums and sums of products are whole numbers: a model is the same for any
partitioning and order of the rows. Sums are made in the tasks and added by Spark; the driver sees one row for each class and
entry. All labelled rows are used, with no sample. Texts are read once, whole; fitting and scoring read the statistics.

Null and empty texts have defined statistics and a score like any other. Rows are judged by their text alone, so repeated rows and
rows that share an id score alike. A document whose labels differ counts for the one that more of them give (1 in a tie); null
labels and labels of null ids count for nothing. Without rows of one class the score is the smoothed share of class 1. Extra
columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import pinned
from .common import id_mod, map_rows, raw_text
from .registry import query, table

STATISTICS = (
    "words", "bytes_a_word", "spread_of_word_bytes", "longest_word", "distinct_words", "commonest_word", "distinct_pairs",
    "adjacent_repeats", "lines", "repeated_lines", "capitals", "digits", "symbols", "marks", "words_of_letters", "entropy")
STEPS = 1024  # a statistic is a whole number of 1/1024
LIMIT = 31  # in size; products of two then stay below 2**30
TO_POOLED = 0.05  # least weight of the pooled covariance
TO_DIAGONAL = 0.05
ACCEPT = 0.3

CAPITALS, DIGITS, SMALL = (np.arange(ord(a), ord(b) + 1) for a, b in ("AZ", "09", "az"))
MARKS = np.frombuffer(b".,;:!?'\"()-", np.uint8)
SYMBOLS = np.setdiff1d(np.arange(33, 127), np.concatenate([CAPITALS, DIGITS, SMALL, MARKS]))


def _odds(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(body: bytes) -> list[int]:
    """The whole-number statistics of a text."""
    words = body.split()
    n, size = len(words), len(body)
    sizes = np.fromiter(map(len, words), np.int64, n)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in body.split(b"\n") if x.strip()]
    at = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    letters = int(at[CAPITALS].sum() + at[SMALL].sum() + at[128:].sum())
    share = at[at > 0] / max(size, 1)
    plain = sum(1 for w in words if w.strip(b".,;:!?'\"()-").isalpha() or w[:1] >= b"\x80")
    values = (
        np.log1p(n), np.log1p(sizes.mean()) if n else 0.0, np.log1p(sizes.std()) if n else 0.0, np.log1p(sizes.max()) if n else 0.0,
        _odds(len(seen), n), _odds(max(seen.values(), default=0), n), _odds(pairs, max(n - 1, 0)), _odds(same, max(n - 1, 0)),
        np.log1p(len(lines)), _odds(len(lines) - len(set(lines)), len(lines)), _odds(at[CAPITALS].sum(), letters), _odds(at[DIGITS].sum(), size),
        _odds(at[SYMBOLS].sum(), size), _odds(at[MARKS].sum(), size), _odds(plain, n), -float((share * np.log2(share)).sum()))
    return [int(x) for x in np.clip(np.rint(np.array(values) * STEPS), -LIMIT * STEPS, LIMIT * STEPS)]


def document_statistics(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` (of type long) and ``stats``, the whole-number statistics."""
    def setup():
        return lambda *cells: [(*cells[:-1], statistics(cells[-1] or b""))]

    return map_rows(docs.select(*keep, raw_text(text)), setup, [*((k, "long") for k in keep), ("stats", "array<int>")])


def settled_labels(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(doc_id, label) of each labelled document, 0 or 1: what more of its labels say."""
    return labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("doc_id")).agg(
        (F.avg(label) >= 0.5).cast("int").alias("label"))


@dataclass(frozen=True)
class Model:
    """Means, Cholesky factors of the covariances and log of the class share, by class; no classes: ``share`` is every score."""
    share: float
    classes: tuple[tuple[np.ndarray, np.ndarray, float], ...] = ()

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        mean, factor, log_share = self.classes[k]
        z = (x - mean).T.copy()
        for i in range(len(mean)):  # forward substitution, for all rows at once
            z[i] = (z[i] - factor[i, :i] @ z[:i]) / factor[i, i]
        return log_share - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(axis=0)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(stats), self.share)
        x = stats / STEPS
        gap = np.clip(self.log_density(x, 1) - self.log_density(x, 0), -700, 700)
        return 1.0 / (1.0 + np.exp(-gap))


def model_of(count: Sequence[int], total: Sequence[Sequence[int]], products: Sequence[np.ndarray],
             to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Model:
    """The model of exact sums by class: rows, sums of statistics, and sums of their products."""
    d, n = len(STATISTICS), sum(count)
    share = (count[1] + 1) / (n + 2)
    if not all(count):
        return Model(share)
    means, scatter = [], []
    for k in (0, 1):
        c, t = int(count[k]), [int(x) for x in total[k]]
        # Exact whole numbers up to the division, so nothing cancels.
        s = np.array([[(c * int(products[k][i][j]) - t[i] * t[j]) / c for j in range(d)] for i in range(d)]) / STEPS**2
        means.append(np.array([x / c for x in t]) / STEPS)
        scatter.append(s)
    pooled = (scatter[0] + scatter[1]) / n + np.eye(d) / STEPS**2  # rounding alone spreads by about so much
    classes = []
    for k in (0, 1):
        weight = max(to_pooled, d / (count[k] + d))
        mixed = (1 - weight) * scatter[k] / count[k] + weight * pooled
        mixed = (1 - to_diagonal) * mixed + to_diagonal * np.diag(np.diag(pooled))
        classes.append((means[k], np.linalg.cholesky(mixed), float(np.log((count[k] + 1) / (n + 2)))))
    return Model(share, tuple(classes))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """The model of the rows of ``stats`` (doc_id, stats) whose id ``labels`` (doc_id, label) has."""
    d = len(STATISTICS)
    fields = pa.schema([("label", pa.int32()), ("entry", pa.int32()), ("part", pa.int64())])

    def sums(batches):
        for batch in batches:
            label = batch.column(0).to_numpy()
            x = np.array(batch.column(1).to_pylist(), np.int64).reshape(-1, d)
            for k in (0, 1):
                mine = np.concatenate([np.ones((int((label == k).sum()), 1), np.int64), x[label == k]], axis=1)
                part = (mine.T @ mine).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(np.arange(len(part), dtype=np.int32)),
                                                  pa.array(part)], schema=fields)

    parts = stats.join(labels, "doc_id").select("label", "stats").mapInArrow(sums, "label int, entry int, part long")
    table_ = np.zeros((2, (d + 1) ** 2), object)
    for r in parts.groupBy("label", "entry").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("sum")).collect():  # 2 x 289 rows
        table_[r.label, r.entry] = int(r.sum)
    whole = table_.reshape(2, d + 1, d + 1)
    return model_of(whole[:, 0, 0], whole[:, 0, 1:], whole[:, 1:, 1:])


def scored(stats: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` (of type long) and ``score``."""
    d, names = len(STATISTICS), [*keep, "score"]

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(len(keep)).to_pylist(), np.int64).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(model.scores(x), pa.float64())], names)

    return stats.select(*(F.col(k).cast("long").alias(k) for k in keep), "stats").mapInArrow(
        run, ", ".join([*(f"`{k}` long" for k in keep), "score double"]))


def quality_scores(docs: DataFrame, labels: DataFrame, train: Callable[[str], object] | None = None) -> DataFrame:
    """Per row: doc_id and score, learnt from ``labels`` (doc_id, quality), or from those that the condition ``train("doc_id")`` keeps."""
    stats = pinned(document_statistics(docs), "quality-statistics")
    used = labels.where(train("doc_id")) if train else labels
    return scored(stats, fit(stats, settled_labels(used)))


@query("op11_quality_classifier")
def op11_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    held_out = id_mod("doc_id", 5) == 0
    out = quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"), train=lambda c: id_mod(c, 5) != 0)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
