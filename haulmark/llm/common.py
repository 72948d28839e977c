"""What the text operators share: words, row-wise Arrow maps, hashing of word windows.

Words are ``[^\\x20\\x09-\\x0D]+``; ``bytes.split()`` splits at exactly these six bytes, so texts travel as UTF-8
bytes. ``map_rows`` streams: a task holds one Arrow batch and the rows made from 256 of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = b"\t\n\x0b\x0c\r "
SLICE = 256

_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
          "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
          "array<double>": pa.list_(pa.float64()), "float": pa.float32()}

Schema = Sequence[tuple[str, str]]


def map_rows(df: DataFrame, setup: Callable[[], Callable[..., Iterable[tuple]]], schema: Schema) -> DataFrame:
    """``setup()`` runs once per task; the function it returns takes a row's cells and yields output rows."""
    fields = pa.schema([(n, _ARROW[t]) for n, t in schema])

    def run(batches):
        fn = setup()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = [r for row in zip(*[c.to_pylist() for c in part.columns]) for r in fn(*row)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in schema))


def map_slices(df: DataFrame, setup: Callable[[], Callable[[list[list]], Iterable[tuple]]], schema: Schema) -> DataFrame:
    """As ``map_rows``, but the function takes the columns of up to 256 rows at once."""
    fields = pa.schema([(n, _ARROW[t]) for n, t in schema])

    def run(batches):
        fn = setup()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = list(fn([c.to_pylist() for c in batch.slice(at, SLICE).columns]))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in schema))


def raw_text(name: str = "text") -> Column:
    """The text as its UTF-8 bytes, so that no invalid sequence can stop a task."""
    return F.col(name).cast("string").cast("binary").alias(name)


def id_mod(name: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 400_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (the public splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Windows:
    """Hashes of all windows of consecutive word hashes: a polynomial modulo 2**64 by one running sum.

    With an odd base each power has an inverse, so a window's hash is a difference of running sums times a power.
    """

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            up, down = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def sums(self, h: np.ndarray) -> np.ndarray:
        self._powers(len(h))
        out = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.down[:len(h)], out=out[1:])
        return out

    def of(self, h: np.ndarray, width: int) -> np.ndarray:
        """One mixed hash per window of ``width``; empty if there are fewer words."""
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        s = self.sums(h)
        return mixed((s[width:] - s[:n]) * self.up[:n])

    def spans(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One mixed hash per span [start, end), its length mixed in."""
        s = self.sums(h)
        return mixed(((s[end] - s[start]) * self.up[start]) ^ mixed((end - start).astype(np.uint64)))
