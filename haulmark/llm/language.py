"""Language identification by segmentation-marginalised unigrams.

The pieces are a fixed public vocabulary (a sentencepiece file; only its list of pieces is used). Each language has a
probability for each piece. A word's probability in a language is the sum over all its segmentations into pieces,
which a forward pass over its characters adds up; a text's is the product over its words. Piece probabilities are learned by
expectation maximisation: the expected use of each piece over all segmentations of the training words, a Spark job a round,
whose sums (languages x vocabulary) are all that reaches the driver.

Words are runs of letters of the lower-cased text behind a word mark. A character the vocabulary lacks is its ``<unk>``
piece. The score is the posterior at equal priors, with the evidence of long texts scaled to ``EVIDENCE`` letters, so
that a text half in one language and half in another scores about a half, however long it is.

A text that is null or has no letter gives ``und`` and score 0, as does every text if nothing could be learned. Rows
are judged alone: repeated rows alike. Equal scores go to the first language in order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import tokenizer_path
from .common import SLICE, id_mod, map_slices, mixed, raw_text
from .registry import query, table
from ..session import pinned

VOCABULARY = "piece_bpe_32k.model"
SAMPLE_PER_LANGUAGE = 2_000  # expected training documents a language; the classifier is fitted on these
ROUNDS = 3
SMOOTHING = 0.05
EVIDENCE = 40.0
LEAST_SCORE = 0.5
KNOWN_WORDS = 400_000
UNDETERMINED = "und"
MARK = "▁"

_LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    runs = _LETTERS.findall(text.lower())
    return runs if any(c.isalpha() for r in runs for c in r) else []


class Pieces:
    """The vocabulary: piece -> id, with ``unk`` for a character it lacks and ``none`` for no piece."""

    _made: dict[str, "Pieces"] = {}

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(path))
        self.ids = {model.id_to_piece(i): i for i in range(model.get_piece_size())
                    if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.unk, self.size = model.unk_id(), model.get_piece_size()
        self.none, self.longest = self.size, max(map(len, self.ids))
        # Per length, the pieces' hashes in order and their ids: all substrings of many words are looked up at once.
        self.tables = {}
        for n in range(1, self.longest + 1):
            found = [x for x in self.ids if len(x) == n]
            if found:
                h = self._hashes(_codes(found, n))[0][n - 1][:, 0]
                order = np.argsort(h)
                self.tables[n] = h[order], np.array([self.ids[found[i]] for i in order], np.int32)

    def _hashes(self, codes: np.ndarray) -> tuple[list[np.ndarray], int]:
        """For each length, the hashes of all substrings of that length, [word, start]."""
        base, k = np.uint64(0x9E3779B97F4A7C15), min(codes.shape[1], self.longest)
        out = [codes]
        for m in range(2, k + 1):
            out.append(out[-1][:, :-1] * base + codes[:, m - 1:])
        return out, k

    @classmethod
    def of(cls, path: str) -> "Pieces":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def lattice(self, words: list[str]) -> np.ndarray:
        """Piece ids for words of one length: [word, end - 1, piece length - 1]."""
        n = len(words[0])
        hashes, k = self._hashes(_codes(words, n))
        out = np.full((len(words), n, k), self.none, np.int32)
        for m in range(1, k + 1):
            if m in self.tables:
                keys, ids = self.tables[m]
                at = np.minimum(np.searchsorted(keys, hashes[m - 1]), len(keys) - 1)
                out[:, m - 1:, m - 1] = np.where(keys[at] == hashes[m - 1], ids[at], self.none)
        first = out[:, :, 0]
        first[first == self.none] = self.unk
        return out


def _codes(words: list[str], n: int) -> np.ndarray:
    """A hash of each character, [word, place]."""
    return mixed(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n).astype(np.uint64) + np.uint64(1))


def by_length(words: list[str]):
    """Index lists of words of equal length, few enough at a time for bounded memory."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, members in groups.items():
        step = max(1, 200_000 // (n * 16))
        for at in range(0, len(members), step):
            yield members[at:at + step]


def _log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials over axis 1."""
    top = x.max(axis=1, keepdims=True)
    top[top == -np.inf] = 0
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]


def forward(ids: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log probabilities of all prefixes, [word, length, language], summed over segmentations.

    ``logs`` is [piece, language] with a last row of minus infinity for no piece.
    """
    count, n, k = ids.shape
    out = np.full((count, n + 1, logs.shape[1]), -np.inf)
    out[:, 0] = 0
    for end in range(1, n + 1):
        m = min(end, k)
        out[:, end] = _log_sum(out[:, end - m:end][:, ::-1] + logs[ids[:, end - 1, :m]])
    return out


def backward(ids: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log probabilities of all suffixes."""
    count, n, k = ids.shape
    out = np.full((count, n + 1, logs.shape[1]), -np.inf)
    out[:, n] = 0
    for start in range(n - 1, -1, -1):
        m = min(n - start, k)
        lengths = np.arange(m)
        out[:, start] = _log_sum(out[:, start + 1:start + 1 + m] + logs[ids[:, start + lengths, lengths]])
    return out


def totals(ids: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """Log of the last column of ``forward``, with plain probabilities that are scaled up on the way."""
    count, n, k = ids.shape
    out = np.zeros((count, n + 1, probabilities.shape[1]))
    out[:, 0] = 1
    scale = np.zeros(out[:, 0].shape)
    for end in range(1, n + 1):
        m = min(end, k)
        out[:, end] = (out[:, end - m:end][:, ::-1] * probabilities[ids[:, end - 1, :m]]).sum(axis=1)
        if end % 16 == 0:  # a piece's probability is far above 1e-18, so 16 steps stay in range
            low = max(0, end - k)
            top = out[:, low:end + 1].max(axis=1)
            out[:, low:end + 1] /= top[:, None]
            scale += np.log(top)
    return np.log(out[:, n]) + scale


def word_scores(words: list[str], logs: np.ndarray, pieces: Pieces) -> np.ndarray:
    """[word, language] log probabilities."""
    marked, probabilities = [MARK + w for w in words], np.exp(logs)
    out = np.empty((len(words), logs.shape[1]))
    for some in by_length(marked):
        out[some] = totals(pieces.lattice([marked[i] for i in some]), probabilities)
    return out


def expected_pieces(words: list[str], counts: np.ndarray, logs: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected uses of each piece in counted words of one language; ``logs`` has one column."""
    marked, out = [MARK + w for w in words], np.zeros(pieces.size + 1)
    for some in by_length(marked):
        ids = pieces.lattice([marked[i] for i in some])
        a, b = forward(ids, logs)[:, :, 0], backward(ids, logs)[:, :, 0]
        weight = counts[some]
        for end in range(1, ids.shape[1] + 1):
            m = min(end, ids.shape[2])
            part = ids[:, end - 1, :m]
            use = np.exp(a[:, end - m:end][:, ::-1] + logs[part, 0] + b[:, end, None] - a[:, -1:, ]) * weight[:, None]
            np.add.at(out, part.ravel(), use.ravel())
    return out[:-1]


def _with_none(logs: np.ndarray) -> np.ndarray:
    return np.vstack([logs, np.full((1, logs.shape[1]), -np.inf)])


class LanguageModel:
    """``languages`` and their piece log probabilities, [piece, language]; plain arrays that go to every task."""

    def __init__(self, languages: list[str], logs: np.ndarray, vocabulary: str):
        self.languages, self.logs, self.vocabulary = languages, logs, vocabulary


def sampled(docs: DataFrame, text: str, lang: str, doc_id: str, per_language: int) -> tuple[list[str], DataFrame]:
    """The learned languages in order, and (language number, text) of a seeded sample of the labelled documents."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = sorted((r[0], r[1]) for r in labelled.groupBy(F.col(lang).cast("string")).count().collect())
    languages = [x for x, _ in counts]
    if not counts:
        return [], docs.limit(0).select(F.lit(0).alias("language"), raw_text(text))
    number = F.create_map(*chain.from_iterable((F.lit(x), F.lit(i)) for i, x in enumerate(languages)))
    share = F.create_map(*chain.from_iterable((F.lit(x), F.lit(min(1.0, per_language / n))) for x, n in counts))
    draw = F.pmod(F.xxhash64(F.lit(23), F.col(doc_id), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    return languages, labelled.where(draw < share[F.col(lang)]).select(number[F.col(lang)].alias("language"), raw_text(text))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", vocabulary: str = VOCABULARY,
          per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS) -> LanguageModel:
    """Learn from labelled documents; rows without a label or a text teach nothing."""
    languages, sample = sampled(docs, text, lang, doc_id, per_language)
    pieces = Pieces.of(vocabulary)

    def count_words():
        def fn(columns):
            found: Counter = Counter()
            for language, body in zip(*columns):
                for w in letter_runs(body.decode("utf-8", "replace")):
                    found[language, w] += 1
            for (language, w), n in found.items():
                yield language, w, n
        return fn

    words = map_slices(sample, count_words, [("language", "int"), ("word", "string"), ("n", "long")])
    words = pinned(words.groupBy("language", "word").agg(F.sum("n").alias("n")), "language-words")
    logs = np.full((pieces.size, max(1, len(languages))), -np.log(pieces.size))
    for _ in range(rounds if languages else 0):
        table_now = _with_none(logs)

        def expect(batches, table_now=table_now):
            vocab, sums = Pieces.of(vocabulary), {}
            for batch in batches:
                language = np.asarray(batch.column("language"))
                counts = np.asarray(batch.column("n")).astype(float)
                found = batch.column("word").to_pylist()
                for x in np.unique(language).tolist():
                    at = np.flatnonzero(language == x)
                    sums[x] = sums.get(x, 0) + expected_pieces([found[i] for i in at], counts[at], table_now[:, [x]], vocab)
            for x, uses in sums.items():
                piece = np.flatnonzero(uses)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(piece), x, np.int32)), pa.array(piece.astype(np.int32)),
                                                  pa.array(uses[piece])], ["language", "piece", "uses"])

        uses = words.mapInArrow(expect, "language int, piece int, uses double").groupBy("language", "piece").agg(
            F.sum("uses").alias("uses")).toArrow()  # at most languages x vocabulary rows
        counts = np.full(logs.shape, SMOOTHING)
        counts[np.asarray(uses.column("piece")), np.asarray(uses.column("language"))] += np.asarray(uses.column("uses"))
        logs = np.log(counts / counts.sum(axis=0))
    return LanguageModel(languages, logs, vocabulary)


class Scorer:
    """Word scores remembered in a table, for one task."""

    def __init__(self, model: LanguageModel):
        self.pieces, self.logs = Pieces.of(model.vocabulary), _with_none(model.logs)
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, len(model.languages)))

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Summed log probabilities of each text's words; the new words of all texts are scored together."""
        flat = list(chain.from_iterable(texts))
        new = set(flat).difference(self.known)
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = set(flat)
        self._add(list(new))
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        ends = np.cumsum([len(t) for t in texts])
        return [self.rows[at[e - len(t):e]].sum(axis=0) for t, e in zip(texts, ends.tolist())]

    def _add(self, words: list[str]) -> None:
        size = len(self.known)
        if size + len(words) > len(self.rows):
            grown = np.empty((max(2 * len(self.rows), size + len(words)), self.rows.shape[1]))
            grown[:size] = self.rows[:size]
            self.rows = grown
        self.rows[size:size + len(words)] = word_scores(words, self.logs, self.pieces)
        self.known.update(zip(words, range(size, size + len(words))))


def posterior(total: np.ndarray, letters: int, evidence: float = EVIDENCE) -> np.ndarray:
    x = total * min(1.0, evidence / letters)
    x = np.exp(x - x.max())
    return x / x.sum()


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep=("doc_id",), types=("long",)) -> DataFrame:
    """The columns ``keep`` (of the given types) with ``lang_pred`` and ``score``."""
    def setup():
        scorer = Scorer(model)

        def fn(columns):
            texts = [letter_runs((body or b"").decode("utf-8", "replace")) for body in columns[-1]]
            for kept, words, total in zip(zip(*columns[:-1]), texts, scorer.of(texts)):
                if not words or not model.languages:
                    yield (*kept, UNDETERMINED, 0.0)
                    continue
                p = posterior(total, sum(map(len, words)))
                best = int(p.argmax())
                yield (*kept, model.languages[best], float(p[best]))

        return fn

    return map_slices(docs.select(*keep, raw_text(text)), setup, [*zip(keep, types), ("lang_pred", "string"), ("score", "double")])


def with_language(docs: DataFrame, model: LanguageModel, least: float = LEAST_SCORE, text: str = "text") -> DataFrame:
    """The documents whose language is told with a score of at least ``least``, with their own columns.

    Only the text goes to Python. Texts without a letter go; if the model knows no language, the others stay.
    """
    @F.arrow_udf("boolean")
    def told(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for column in columns:
            keep = []
            for at in range(0, len(column), SLICE):
                texts = [letter_runs((x or b"").decode("utf-8", "replace")) for x in column.slice(at, SLICE).to_pylist()]
                keep += [bool(words) and (not model.languages or float(posterior(total, sum(map(len, words))).max()) >= least)
                         for words, total in zip(texts, scorer.of(texts))]
            yield pa.array(keep, pa.bool_())

    return docs.where(told(raw_text(text)))


FOLDS, HELD_OUT = 3, 1


def predict_held_out(docs: DataFrame) -> DataFrame:
    """All documents, by a model that learns from two of three folds of the ids."""
    held = id_mod("doc_id", FOLDS) == HELD_OUT
    model = train(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=("doc_id", "held_out"), types=("long", "boolean"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return predict_held_out(table(spark, sf, "documents"))
