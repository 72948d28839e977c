"""Language-model scores: causal self-attention over subword ids, by onnxruntime (``graphs``), or numpy where floats end.

A text is its words (lower-cased A-Z) and one end. The model reads the library's subword ids of each word behind a space, then
an end id. One attention layer with relative position biases predicts the class of the next id; ids are dealt to classes by
frequency, and the id within its class follows corpus counts. Its log probability sums over all ids of the text, the end
included.

Texts are *encoded* once; ids of two bytes are written by the round that trains on them, and all else reads these. No id but a
word's first begins with a space, so ids give back the words: a word's hash is one of its ids, which spell it to the byte.

*Counts* of words and of ids cover all training documents: a pass with partial sums. *Attention* is trained by local steps
and averaging: every partition takes Adam steps over its documents of the round, from the common parameters, and sends back
its parameters and how many ids it saw; they are averaged by groups of bounded size. A hash deals the documents to the
``ROUNDS``, so that after the last one each training document was used once. A step reads stretches of consecutive windows,
whose keys and values are computed once for both windows they lie in.

*Scoring* cuts the ids of a text into context windows that overlap by half. A window's second half is scored, with attention,
masked to the past, on the whole window, so each id is scored once; windows of many texts go through as one batch.

*Base*: a word's count is looked up in a bounded table of the most frequent words in each task; the rest, rare by
construction, is joined by hash.

Null and empty texts are the end alone. Rows are scored alone; repeated rows alike. With no training documents counts are
zero and attention untrained, and scores are defined still. An empty table gives an empty result. Words are counted by
64-bit hashes.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import pinned
from . import graphs
from .bpe import BLANK, Encoder, Remembered, tokenizer_path
from .common import SLICE, Windows, id_mod, mixed, raw_text
from .registry import query, table
from .token_files import packed16, packed32

TOKENIZER = "byte_bpe_50k.json"
END = 50_256
WIDTH, HALF = 16, 32  # of vectors; of a window
OWN_ROWS, CLASSES = 2_048, 64
ROUNDS = 4  # each trains on another slice of the documents, all together on every one
STEP, BATCH, STRETCH = 0.01, 64, 8  # windows of a step; of a stretch
WORDS = 500_000  # remembered by a worker
AT_ONCE = 4 << 20  # bytes of texts encoded at once
HEAD = 1 << 18  # most frequent words held by each task: 4 MB
ALPHA = 0.1
FOLDS, HELD_OUT = 10, 0
AVERAGED_AT_ONCE = 64


class Vocabulary:
    """Classes and input rows of ids, from corpus counts; ``inside`` is the log probability of an id within its class."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        mass = np.cumsum(np.sqrt(counts[order] + 0.01))
        self.class_of = np.empty(len(counts), np.int32)
        self.class_of[order] = np.minimum(CLASSES - 1, (mass - mass[0]) / mass[-1] * CLASSES).astype(np.int32)
        self.row_of = (OWN_ROWS + self.class_of).astype(np.int32)
        self.row_of[order[:OWN_ROWS]] = np.arange(min(OWN_ROWS, len(counts)))
        smooth = counts + 0.5
        totals = np.bincount(self.class_of, smooth, CLASSES)
        self.inside = np.log(smooth / totals[self.class_of]).astype(np.float32)
        self.share = np.log((totals + 1e-9) / totals.sum()).astype(np.float32)

    START, PAD, ROWS = OWN_ROWS + CLASSES, OWN_ROWS + CLASSES + 1, OWN_ROWS + CLASSES + 2


def first_parameters(vocabulary: Vocabulary, seed: int = 7) -> dict[str, np.ndarray]:
    rnd = np.random.default_rng(seed)
    draw = lambda *shape: (rnd.standard_normal(shape) * 0.1).astype(np.float32)
    return {"e": draw(Vocabulary.ROWS, WIDTH), "q": draw(WIDTH, WIDTH), "k": draw(WIDTH, WIDTH), "v": draw(WIDTH, WIDTH),
            "b": np.zeros(2 * HALF, np.float32), "o": draw(WIDTH, CLASSES), "c": vocabulary.share.copy()}


def halves_of(ids: list[np.ndarray], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input rows and target ids (-1: none), [half window, place], and each text's number of halves.

    A text begins with an empty half; each of its other halves, behind the one before it, is a window.
    """
    sizes = np.array([-(-len(x) // HALF) + 1 for x in ids])
    rows = np.full(int(sizes.sum()) * HALF, Vocabulary.PAD, np.int32)
    targets = np.full(len(rows), -1, np.int32)
    at = HALF
    for x, n in zip(ids, sizes.tolist()):
        rows[at] = Vocabulary.START
        rows[at + 1:at + len(x)] = vocabulary.row_of[x[:-1]]
        targets[at:at + len(x)] = x
        at += n * HALF
    return rows.reshape(-1, HALF), targets.reshape(-1, HALF), sizes


def windows_of(ids: list[np.ndarray], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Input rows [window, 2 * HALF] and target ids [window, HALF] (-1: none)."""
    rows, targets, sizes = halves_of(ids, vocabulary)
    second = np.ones(len(rows), bool)
    second[np.cumsum(sizes) - sizes] = False
    at = np.flatnonzero(second)
    return np.hstack([rows[at - 1], rows[at]]), targets[at]


_AHEAD = np.arange(HALF)[:, None] + HALF - np.arange(2 * HALF)[None, :]  # how far a key lies behind each query
_PAST = _AHEAD >= 0
_BEHIND = np.where(_PAST, _AHEAD, 0)


def _sums_of_exp(x: np.ndarray, safe: bool) -> np.ndarray:
    """Exponentials in place, up to a factor a row where values may leave the range of floats; returns the rows' shifts."""
    shift = np.zeros(x.shape[:-1] + (1,), x.dtype)
    if not safe:
        shift = x.max(axis=-1, keepdims=True)
        x -= shift
    np.exp(x, out=x)
    return shift


def _overlapping(x: np.ndarray, windows: int) -> np.ndarray:
    """Windows [..., window, 2 * HALF, width] over stretches [..., (windows + 1) * HALF, width], as a view."""
    line, item = x.strides[-2:]
    return np.lib.stride_tricks.as_strided(x, (*x.shape[:-2], windows, 2 * HALF, x.shape[-1]), (*x.strides[:-2], HALF * line, line, item), writeable=False)


class Space(dict):
    """Arrays to be filled again at each call: fresh ones of their size the system maps and clears, which took half the time."""

    def __call__(self, name: str, *shape: int, dtype=np.float32) -> np.ndarray:
        n = math.prod(shape)
        if name not in self or self[name].size < n or self[name].dtype != dtype:
            self[name] = np.empty(n, dtype)
        return self[name][:n].reshape(shape)


def _bias(p: dict) -> np.ndarray:
    return np.where(_PAST, p["b"][_BEHIND], -1e9).astype(p["b"].dtype)


def _window_feeds(before: np.ndarray, near: np.ndarray, classes: np.ndarray) -> dict[str, np.ndarray]:
    """What graphs read of windows: rows and classes of their halves [window, HALF]."""
    return {"rows": np.concatenate([before, near], axis=1, dtype=np.int64), "near": near.astype(np.int64),
            "classes": classes.astype(np.int64)[:, :, None], "ones": np.ones((*near.shape, 1), np.float32)}


def log_probabilities(p: dict, vocabulary: Vocabulary, ids: list[np.ndarray], batch: int = 128) -> np.ndarray:
    """Natural log probability of each text's ids.

    Keys, values, queries and inputs of a row are one row of a table, looked up once an id; windows are overlapping views
    of the looked-up rows. Behind the values stands a one, so that the product with them also sums the weights; where
    nothing stands before a text, both are zero.
    """
    rows, targets, sizes = halves_of(ids, vocabulary)
    d, halves = WIDTH, len(rows)
    one = np.ones((Vocabulary.ROWS, 1), np.float32)
    table_ = np.hstack([p["e"] @ p["k"], p["e"] @ p["q"] / np.float32(math.sqrt(d)), p["e"], p["e"] @ p["v"], one]).astype(np.float32)
    bias = _bias(p).astype(np.float32)
    longest = [float(np.sqrt((table_[:, i * d:(i + 1) * d] ** 2).sum(axis=1).max())) for i in range(4)]
    small = longest[0] * longest[1] + float(np.abs(p["b"]).max()) < 60
    small_out = (longest[2] + longest[3]) * float(np.sqrt((p["o"] ** 2).sum(axis=0).max())) + float(np.abs(p["c"]).max()) < 60
    table_[Vocabulary.PAD, 3 * d:] = 0
    outward = np.vstack([p["o"], p["c"]]).astype(np.float32)
    empty = np.zeros(halves, bool)
    empty[np.cumsum(sizes) - sizes] = True
    out, space = np.zeros(halves), Space()
    if small and small_out:
        queries, (keys, values, e) = table_[:, d:2 * d], (table_[:, i] for i in (slice(d), slice(3 * d, None), slice(2 * d, 3 * d)))
        feeds = {n: np.ascontiguousarray(x) for n, x in (("keys", keys), ("queries", queries), ("values", values), ("e", e), ("bias", bias), ("outward", outward))}
        filled = np.flatnonzero(~empty)
        for at in range(0, len(filled), batch):
            at = filled[at:at + batch]
            t = targets[at]
            there = t >= 0
            t = np.where(there, t, 0)
            feeds |= _window_feeds(rows[at - 1], rows[at], vocabulary.class_of[t])
            each = graphs.scores(d).run(None, feeds)[0][:, :, 0] + vocabulary.inside[t]
            out[at] = np.where(there, each, 0).sum(axis=1, dtype=np.float64)
        return np.add.reduceat(out, np.cumsum(sizes) - sizes)
    for at in range(1, halves, batch):
        end = min(halves, at + batch)
        n = end - at
        found = np.take(table_, rows[at - 1:end].ravel(), axis=0, out=space("found", (n + 1) * HALF, 4 * d + 1), mode="clip")
        window = _overlapping(found, n)
        s = np.matmul(window[:, HALF:, d:2 * d], window[:, :, :d].transpose(0, 2, 1), out=space("s", n, HALF, 2 * HALF))
        s += bias
        if not small:
            s[empty[at - 1:end - 1], :, :HALF] = -1e9
        _sums_of_exp(s, small)
        h = np.matmul(s, window[:, :, 3 * d:], out=space("h", n, HALF, d + 1))
        h /= np.maximum(h[:, :, d:], np.float32(1e-30))
        h[:, :, :d] += window[:, HALF:, 2 * d:3 * d]
        h[:, :, d] = 1
        logits = np.matmul(h, outward, out=space("logits", n, HALF, CLASSES)).reshape(n * HALF, -1)  # a product a window: in one of all, rounding would hang on a row's place
        t = targets[at:end].ravel()
        there = t >= 0
        t = np.where(there, t, 0)
        picked = logits[np.arange(len(t)), vocabulary.class_of[t]]
        shift = _sums_of_exp(logits, small_out)
        each = picked - shift[:, 0] - np.log(logits.sum(axis=1)) + vocabulary.inside[t]
        out[at:end] = np.where(there, each, 0).reshape(n, HALF).sum(axis=1, dtype=np.float64)
    return np.add.reduceat(out, np.cumsum(sizes) - sizes)


def _rows_added(rows: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the lines of ``x`` by row."""
    cells = rows[:, None] * x.shape[1] + np.arange(x.shape[1])
    return np.bincount(cells.ravel(), x.ravel(), n * x.shape[1]).reshape(n, -1).astype(x.dtype)


def gradients(p: dict, rows: np.ndarray, classes: np.ndarray, space: Space | None = None) -> tuple[dict, float]:
    """Mean cross entropy of the next class (-1: none) and its gradients.

    ``rows`` [stretch, (n + 1) * HALF] are stretches of n consecutive windows, ``classes`` [stretch, n * HALF]. Weights stay
    as they come from the exponential; their sum, from a column of ones behind the values, divides the outcome.
    """
    d, dtype = WIDTH, p["e"].dtype
    stretches, n = len(rows), rows.shape[1] // HALF - 1
    halves, space = (stretches, n, HALF), functools.partial(Space() if space is None else space, dtype=dtype)
    take = lambda x, y, name, *shape: np.matmul(x, y, out=space(name, *shape))
    flat = lambda x: x.reshape(-1, x.shape[-1])
    e = np.take(p["e"], rows, axis=0, out=space("e", *rows.shape, d), mode="clip")
    near = space("near", stretches * n * HALF, d)
    near.reshape(stretches, -1, d)[:] = e[:, HALF:]
    to_q = p["q"] * dtype.type(1 / math.sqrt(d))
    q = take(near, to_q, "q", len(near), d).reshape(*halves, d)
    k = take(flat(e), p["k"], "k", rows.size, d).reshape(e.shape)
    v = space("v", *rows.shape, d + 1)
    v[:, :, :d] = take(flat(e), p["v"], "v0", rows.size, d).reshape(e.shape)
    v[:, :, d] = 1
    none = rows == Vocabulary.PAD
    v[none] = 0
    keys, values = _overlapping(k, n), _overlapping(v, n)
    s = take(q, keys.swapaxes(2, 3), "s", *halves, 2 * HALF)
    s += _bias(p)
    if math.sqrt((flat(q) ** 2).sum(axis=1).max() * (flat(k) ** 2).sum(axis=1).max()) + np.abs(p["b"]).max() < 60:
        np.exp(s, out=s)
    else:
        np.copyto(s, -1e9, where=_overlapping(none[:, :, None], n).swapaxes(2, 3))
        _sums_of_exp(s, False)
    out = flat(take(s, values, "out", *halves, d + 1))
    total = np.maximum(out[:, d:], dtype.type(1e-30))
    seen = out[:, :d] / total
    out[:, :d] = seen + near
    out[:, d] = 1
    outward = np.vstack([p["o"], p["c"]])
    logits = take(out, outward, "logits", len(out), CLASSES)

    want = classes.ravel()
    there = want >= 0
    weight = there.astype(dtype) / max(1, int(there.sum()))
    want, line = np.where(there, want, 0), np.arange(len(want))
    picked = logits[line, want]
    shift = _sums_of_exp(logits, (out ** 2).sum(axis=1).max() * (outward ** 2).sum(axis=0).max() < 3600)[:, 0]
    sums = logits @ np.ones(CLASSES, dtype)
    loss = -float(((picked - shift - np.log(sums)) * weight).sum())
    logits *= (weight / sums)[:, None]
    logits[line, want] -= weight

    d_outward = out.T @ logits
    d_out = take(logits, p["o"].T, "d_out", len(out), d)
    back = space("back", len(out), d + 1)
    np.divide(d_out, total, out=back[:, :d])
    back[:, d] = -np.einsum("ij,ij->i", back[:, :d], seen)
    back = back.reshape(*halves, d + 1)
    d_s = take(back, values.swapaxes(2, 3), "d_s", *halves, 2 * HALF)
    d_values = take(s.swapaxes(2, 3), back[..., :d], "d_values", stretches, n, 2 * HALF, d)
    d_s *= s
    d_q = flat(take(d_s, keys, "d_q", *halves, d))
    d_keys = take(d_s.swapaxes(2, 3), q, "d_keys", stretches, n, 2 * HALF, d)
    d_bias = (np.ones(stretches * n, dtype) @ d_s.reshape(stretches * n, -1)).reshape(HALF, 2 * HALF)

    def met(x, name):  # a half is the first of one window and the second of the one before
        y = space(name, stretches, n + 1, HALF, d)
        y[:, :-1], y[:, -1] = x[:, :, :HALF], 0
        y[:, 1:] += x[:, :, HALF:]
        return y.reshape(-1, d)

    d_k, d_v = met(d_keys, "d_k"), met(d_values, "d_v")
    d_v[none.ravel()] = 0
    d_e = take(d_k, p["k"].T, "d_e", rows.size, d)
    d_e += take(d_v, p["v"].T, "v0", rows.size, d)
    d_out += d_q @ to_q.T
    d_e.reshape(e.shape)[:, HALF:] += d_out.reshape(stretches, -1, d)
    return {"e": _rows_added(rows.ravel(), d_e, len(p["e"])), "q": near.T @ d_q * dtype.type(1 / math.sqrt(d)), "k": flat(e).T @ d_k,
            "v": flat(e).T @ d_v, "b": np.bincount(_BEHIND[_PAST], d_bias[_PAST], 2 * HALF).astype(dtype),
            "o": d_outward[:d], "c": d_outward[d]}, loss


def quick_gradients(p: dict, rows: np.ndarray, classes: np.ndarray, space: Space | None = None) -> dict:
    """The gradients of ``gradients`` by onnxruntime, unless sums of exponentials near the ends of the range of floats."""
    halves, want = rows.reshape(len(rows), -1, HALF), classes.reshape(-1, HALF)
    filled = np.flatnonzero(want[:, 0] >= 0)  # a half has no gap: the others have nothing to predict
    want, before, near = want[filled], halves[:, :-1].reshape(-1, HALF)[filled], halves[:, 1:].reshape(-1, HALF)[filled]
    found = np.zeros(Vocabulary.ROWS, bool)
    found[before], found[near] = True, True
    place, read = np.cumsum(found) - 1, np.flatnonzero(found)
    there = (read != Vocabulary.PAD).astype(np.float32)[:, None]
    known = want >= 0
    weight = known[:, :, None] * np.float32(1 / max(1, np.count_nonzero(known)))
    scale = np.float32(1 / math.sqrt(WIDTH))
    feeds = _window_feeds(place[before], place[near], np.maximum(want, 0)) | {
        "e": p["e"][read] * there, "there": there, "zeros": np.zeros((len(read), WIDTH), np.float32), "q": p["q"] * scale, "k": p["k"], "v": p["v"],
        "bias": _bias(p), "o": p["o"], "outward": np.vstack([p["o"], p["c"]]), "weight": weight}
    if not len(filled):
        return gradients(p, rows, classes, space)[0]
    d_e, d_q, d_k, d_v, d_bias, d_outward, *sums = graphs.gradients(WIDTH, CLASSES).run(graphs.GRADIENTS, feeds)
    if not all(1e-30 < float(x) < 1e30 for x in sums):
        return gradients(p, rows, classes, space)[0]
    every = np.zeros_like(p["e"])
    every[read] = d_e * there
    return {"e": every, "q": d_q * scale, "k": d_k, "v": d_v, "b": np.bincount(_BEHIND[_PAST], d_bias[_PAST], 2 * HALF).astype(np.float32),
            "o": d_outward[:WIDTH], "c": d_outward[WIDTH]}


def stretches_of(ids: list[np.ndarray], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Input rows [stretch, (STRETCH + 1) * HALF] and classes to predict [stretch, STRETCH * HALF] (-1: none)."""
    rows, targets, _ = halves_of(ids, vocabulary)
    n = -(-(len(rows) - 1) // STRETCH)
    more = n * STRETCH + 1 - len(rows)
    rows = np.pad(rows, ((0, more), (0, 0)), constant_values=Vocabulary.PAD)
    classes = np.where(targets >= 0, vocabulary.class_of[np.maximum(targets, 0)], -1)
    classes = np.pad(classes, ((0, more), (0, 0)), constant_values=-1)[1:]
    at = np.arange(n)[:, None] * STRETCH + np.arange(STRETCH + 1)
    return rows[at].reshape(n, -1), classes.reshape(n, -1)


class Adam:
    """Adam over all parameters as one vector; ``p`` are views of it."""

    def __init__(self, p: dict, step: float = STEP):
        self.names, self.step, self.t = sorted(p), step, 0
        self.x = np.concatenate([p[n].ravel() for n in self.names])
        self.m, self.v, self.some = np.zeros_like(self.x), np.zeros_like(self.x), np.empty_like(self.x)
        ends = np.cumsum([p[n].size for n in self.names])
        self.p = {n: self.x[end - p[n].size:end].reshape(p[n].shape) for n, end in zip(self.names, ends)}

    def update(self, g: dict) -> None:
        self.t += 1
        rate, some = self.step * math.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t), self.some
        flat = np.concatenate([g[n].ravel() for n in self.names])
        self.m *= 0.9
        self.m += np.multiply(flat, 0.1, out=some)
        self.v *= 0.999
        flat *= flat
        self.v += np.multiply(flat, 0.001, out=some)
        np.sqrt(self.v, out=some)
        some += 1e-8
        np.divide(self.m, some, out=some)
        some *= rate
        self.x -= some


class Reader(Remembered):
    """Packed ids of words behind a space, remembered up to ``WORDS`` words, and hashes of words from ids."""

    _made: dict[str, "Reader"] = {}

    def __init__(self, tokenizer: str = TOKENIZER):
        super().__init__(WORDS)
        path = tokenizer_path(tokenizer)
        self.encoder = Encoder.of(path, packed16)
        tokens = self.encoder.lib.get_vocab()
        self.size = max(END + 1, 1 + max(tokens.values()))
        self.type = np.dtype("<u2")
        if self.size > 1 << 16:
            self.encoder, self.type = Encoder.of(path, packed32), np.dtype("<u4")
        self.first = np.zeros(self.size, bool)
        self.first[[i for t, i in tokens.items() if t.startswith(BLANK)]] = True
        self.hash_of, self.windows = mixed(np.arange(1, self.size + 1, dtype=np.uint64)), Windows()

    @classmethod
    def of(cls, tokenizer: str = TOKENIZER) -> "Reader":
        """One a worker process, kept across its tasks."""
        if tokenizer not in cls._made:
            cls._made[tokenizer] = cls(tokenizer)
        return cls._made[tokenizer]

    def __missing__(self, word: bytes) -> bytes:
        value = self.older.get(word)
        if value is None:
            try:
                value = self.encoder.unit_value(" ", word.decode())
            except UnicodeDecodeError:
                value = self.encoder.bytes_value(b" " + word)
        if len(word) <= 64:
            self.remember(word, value)
        return value

    def words(self, body: bytes | None) -> list[bytes]:
        return (body or b"").lower().split()

    def packed(self, body: bytes | None) -> bytes:
        return self.packed_texts(pa.array([body], pa.binary()))[0]

    def packed_texts(self, bodies: pa.Array) -> list[bytes]:
        """Packed ids of texts; each distinct word of theirs is looked up once. Arrow lower-cases and splits at the bytes at which ``words`` does."""
        texts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(bodies, b"").view(pa.string())))
        words = texts.values.view(pa.binary()).dictionary_encode()
        values = pa.array([self[w] if w else b"" for w in words.dictionary.to_pylist()], pa.large_binary())  # empty before leading and behind trailing white space
        found = values.take(words.indices)
        at = np.frombuffer(found.buffers()[1], np.int64)[texts.offsets.to_numpy()].tolist()
        raw, end = (found.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), self.encoder.value([END])
        return [raw[a:b] + end for a, b in zip(at, at[1:])]

    def unpacked(self, cell: bytes) -> np.ndarray:
        return np.frombuffer(cell, self.type)

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.append(self.unpacked(b"".join(map(self.__getitem__, words))).astype(np.int32), np.int32(END))

    def word_hashes(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the texts, ends included, and where in them each text begins (and the last ends)."""
        ids = np.concatenate(texts)
        begins = self.first[ids]
        ends = np.cumsum([len(t) for t in texts])
        begins[ends - 1] = True
        start = np.flatnonzero(begins)
        hashes = self.windows.spans(self.hash_of[ids], start, np.append(start[1:], len(ids)))
        return hashes, np.append(0, np.searchsorted(start, ends))


def some_at_once(texts: list, size: int):
    """Runs of consecutive texts of about ``size`` ids, but of one at least."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= size):
            held += len(texts[end])
            end += 1
        yield at, end
        at = end


def encoded(docs: DataFrame, held: Column, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """row, doc_id, ids and slice of each document: the round that trains on it, -1 if it is ``held`` out."""
    draw = F.pmod(F.xxhash64(F.lit(31), F.col("doc_id"), F.col(text)), F.lit(rounds)).cast("int")

    fields = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary()), ("slice", pa.int32())])

    def run(batches):
        from pyspark import TaskContext

        reader, row = Reader.of(), TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_id, part, bodies = batch.columns
            ends = np.cumsum(pc.fill_null(pc.binary_length(bodies), 0).to_numpy().astype(np.int64))
            at = 0
            while at < len(ends):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + end - at)), doc_id[at:end], pa.array(reader.packed_texts(bodies[at:end]), pa.binary()),
                                                  part[at:end]], schema=fields)
                row, at = row + end - at, end

    found = docs.select("doc_id", F.when(held, -1).otherwise(draw).alias("slice"), raw_text(text)).mapInArrow(run, "row long, doc_id long, ids binary, slice int")
    return pinned(found, "lm-ids", partition_by=["slice"])


def _pack(p: dict) -> bytes:
    return b"".join(p[n].astype("<f4").tobytes() for n in sorted(p))


def _unpack(blob: bytes, like: dict) -> dict:
    flat, out, at = np.frombuffer(blob, "<f4"), {}, 0
    for n in sorted(like):
        out[n] = flat[at:at + like[n].size].reshape(like[n].shape).copy()
        at += like[n].size
    return out


def corpus_counts(ids: DataFrame) -> DataFrame:
    """(key, n) by word hash, the end included, and with ``subword`` set of ids, over the rows of ``encoded``."""
    def run(batches):
        reader = Reader.of()
        total = np.zeros(reader.size, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            word, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return word, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows(word, n, subword):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(word), subword)), pa.array(word), pa.array(n)], ["subword", "key", "n"])

        for batch in batches:
            texts = [reader.unpacked(x) for x in batch.column(0).to_pylist()]
            for at, end in some_at_once(texts, 1_000_000):
                total += np.bincount(np.concatenate(texts[at:end]), minlength=len(total))
                held.append(np.unique(reader.word_hashes(texts[at:end])[0], return_counts=True))
                if sum(len(h) for h, _ in held) > 1_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 500_000:
                        yield rows(held[0][0].view(np.int64), held[0][1], False)
                        held = []
        if held:
            word, n = merged()
            yield rows(word.view(np.int64), n, False)
        there = np.flatnonzero(total)
        yield rows(there, total[there], True)

    return ids.select("ids").mapInArrow(run, "subword boolean, key long, n long").groupBy("subword", "key").agg(F.sum("n").alias("n"))


def train_attention(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", rounds: int = ROUNDS) -> dict:
    """Parameters after ``rounds`` of local steps and averaging, each over its own slice of the documents."""
    return trained(encoded(docs, F.lit(False), text, rounds), vocabulary, rounds)


def trained(ids: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> dict:
    """As ``train_attention``, over the rows of ``encoded``."""
    p = first_parameters(vocabulary)
    for r in range(rounds):
        start = _pack(p)

        def run(batches, start=start):
            from pyspark import TaskContext

            reader, adam = Reader.of(), Adam(_unpack(start, first_parameters(vocabulary)))
            seen, waiting, held, space = 0, [], 0, Space()

            def step(some):
                rows, classes = stretches_of(some, vocabulary)
                order = np.random.default_rng(len(rows)).permutation(len(rows))
                for at in range(0, len(rows), BATCH // STRETCH):
                    pick = order[at:at + BATCH // STRETCH]
                    adam.update(quick_gradients(adam.p, rows[pick], classes[pick], space))
                return sum(map(len, some))

            for batch in batches:
                for cell in batch.column(0):
                    waiting.append(reader.unpacked(cell.as_py()))
                    held += len(waiting[-1])
                    if held > 100_000:
                        seen += step(waiting)
                        waiting, held = [], 0
            if waiting:
                seen += step(waiting)
            if seen:
                total = np.frombuffer(_pack(adam.p), "<f4") * np.float64(seen)
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen], pa.int64()),
                                                  pa.array([total.tobytes()], pa.binary())], ["task", "seen", "total"])

        sums = pinned(ids.where(F.col("slice") == r).select("ids").mapInArrow(run, "task long, seen long, total binary"), "lm-parts")
        while (n := sums.count()) > AVERAGED_AT_ONCE:
            grouped = sums.groupBy(F.pmod("task", F.lit(-(-n // AVERAGED_AT_ONCE))).alias("group"))
            sums = pinned(grouped.applyInArrow(_added, "task long, seen long, total binary"), "lm-parts")
        parts = sums.toArrow()
        if parts.num_rows:
            total = np.sum([np.frombuffer(x.as_py(), "<f8") for x in parts.column("total")], axis=0)
            p = _unpack((total / sum(parts.column("seen").to_pylist())).astype("<f4").tobytes(), p)
    return p


def _added(group):
    total = np.sum([np.frombuffer(x.as_py(), "<f8") for x in group.column("total")], axis=0)
    return pa.table({"task": pa.array([min(group.column("task").to_pylist())], pa.int64()),
                     "seen": pa.array([sum(group.column("seen").to_pylist())], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})


class Head:
    """Counts of the most frequent words, and what the rest needs."""

    def __init__(self, counts: DataFrame):
        """``counts`` (key, n) is read twice."""
        sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toArrow().to_pandas().sort_values("n", ascending=False)
        self.total = int((sizes["n"] * sizes["words"]).sum())
        self.distinct = int(sizes["words"].sum())
        fits = sizes[sizes["words"].cumsum() <= HEAD]
        self.words, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(fits):
            found = counts.where(F.col("n") >= int(fits["n"].min())).select("key", "n").toArrow()
            word = found.column("key").to_numpy().view(np.uint64)
            order = np.argsort(word)
            self.words, self.counts = word[order], found.column("n").to_numpy()[order]

    def split(self, hashes: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
        """For each text, whose words begin at ``cut``: how many are in the head, their summed log10(count + ALPHA), the others and how often each occurs."""
        coded = pa.array(hashes).dictionary_encode()
        word, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        hit, weight = np.zeros(len(word), np.int64), np.zeros(len(word))
        if len(self.words):
            k = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            hit[:] = self.words[k] == word
            weight = np.where(hit, np.log10(self.counts[k] + ALPHA), 0)
        known, base = (np.add.reduceat(x[at], cut[:-1]) for x in (hit, weight))  # no text is without words: each has its end
        rare = np.flatnonzero(hit[at] == 0)
        one, times = np.unique((np.searchsorted(cut, rare, "right") - 1) * len(word) + at[rare], return_counts=True)
        offsets = pa.array(np.searchsorted(one, np.arange(len(cut)) * len(word)), pa.int32())
        lists = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (word[one % len(word)].view(np.int64), times.astype(np.int64)))
        return known, base, *lists


def score_documents(ids: DataFrame, head: Head, vocabulary: Vocabulary, p: dict) -> DataFrame:
    """Rows of ``encoded``: row, doc_id, slice, n_tokens, the head's part of the base, the tail, and the model's score."""
    vocab, params = vocabulary, _pack(p)
    names = ["row", "doc_id", "slice", "n_tokens", "head_known", "head_base", "tail", "tail_times", "score"]

    def run(batches):
        reader, mine = Reader.of(), _unpack(params, first_parameters(vocab))
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                texts = [reader.unpacked(x) for x in batch.column(3).to_pylist()]
                for at, end in some_at_once(texts, 200_000):  # windows of many texts at once, but not of all
                    scores = log_probabilities(mine, vocab, texts[at:end]) / math.log(10)
                    hashes, cut = reader.word_hashes(texts[at:end])
                    yield pa.RecordBatch.from_arrays([*(batch.column(i)[at:end] for i in range(3)), pa.array(np.diff(cut)), *map(
                        lambda x: x if isinstance(x, pa.Array) else pa.array(x), head.split(hashes, cut)), pa.array(scores)], names)

    return ids.select("row", "doc_id", "slice", "ids").mapInArrow(
        run, "row long, doc_id long, slice int, n_tokens long, head_known long, head_base double, tail array<long>, tail_times array<long>, score double")


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = F.coalesce(id_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    texts = encoded(docs, held)
    training = texts.where("slice >= 0")
    counted = pinned(corpus_counts(training), "lm-counts")
    words = counted.where("not subword").select("key", "n")
    head = Head(words)
    ids = counted.where("subword").select("key", "n").toArrow()  # at most the vocabulary
    frequency = np.zeros(Reader.of().size, np.int64)
    frequency[ids.column("key").to_numpy()] = ids.column("n").to_numpy()
    vocabulary = Vocabulary(frequency)
    p = trained(training, vocabulary)
    scored = pinned(score_documents(texts, head, vocabulary, p), "lm-scores")
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "tail_times")).alias("t")).select(
        "row", F.col("t.tail").alias("key"), F.col("t.tail_times").alias("times"))
    rare = tail.join(words, "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(ALPHA)) * F.col("times")).alias("base"))
    each = math.log10(head.total + ALPHA * (head.distinct + 1))
    return scored.drop("tail", "tail_times").join(rare, "row", "left").select(
        "doc_id", (F.col("slice") < 0).alias("held_out"), "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(head.total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("base", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"), "score")


@query("op5_lm_scores")
def op5_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lm_scores(table(spark, sf, "documents"))
