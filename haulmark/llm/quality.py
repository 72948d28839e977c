"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

Repetitive text compresses too well, noise too little. What is normal depends on length, because short inputs pay
the frame and have nothing to refer back to; so each length band has its own limits. A document is rejected when its
whole ratio leaves its band, or when more than a quarter of its chunks leave theirs (which finds long documents that are
part noise, part filler, and average out). A text of any length is compressed whole and by chunks of ``CHUNK`` bytes.

Null and empty texts have no words and fail the base rule. Each row is judged alone, so repeated rows and ties are
judged alike, and an empty table gives an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import SPACES, Windows, WordHashes, map_rows, raw_text
from .registry import query, table

# (up to so many bytes, least ratio, greatest ratio) of compressed to plain size at the level below. The greatest lie between
# what prose reaches (in Latin letters 1.04, 0.94, 0.87, 0.75, 0.73, 0.70, 0.64, 0.59, from 128 bytes on) and what spaced base64
# noise does not go under (1.03, 0.94, 0.91, 0.85, 0.82, 0.79, 0.77, 0.74). Up to 96 bytes the frame hides the
# difference (prose up to 1.56, noise from 1.09), so there only the base rule judges.
BANDS = ((96, 0.0, 9.0), (128, 0.20, 1.05), (192, 0.20, 0.945), (256, 0.20, 0.90), (384, 0.20, 0.82), (512, 0.20, 0.79),
         (768, 0.18, 0.76), (1024, 0.18, 0.72), (4096, 0.16, 0.68), (16384, 0.14, 0.66), (None, 0.12, 0.64))
LEVEL = 3
CHUNK = 4096
BAD_CHUNKS = 0.25
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WIDTH = 10, 20, 5

COLUMNS = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
           ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("ratio", "double"),
           ("n_chunks", "long"), ("n_bad_chunks", "long"))


def in_band(size: int, ratio: float, bands=BANDS) -> bool:
    low, high = next((lo, hi) for top, lo, hi in bands if top is None or size <= top)
    return low <= ratio <= high


def repeated_words(words: list[bytes], hashes: WordHashes, windows: Windows, width: int = REPEAT_WIDTH) -> int:
    """Words inside windows of ``width`` words that occur twice or more, each word counted once."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    keys = windows.of(hashes.of(words), width)
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    # Equal hashes are only candidates; the words decide.
    seen: dict[tuple, int] = {}
    places = np.flatnonzero(np.isin(keys, np.unique(twice)))
    grams = [tuple(words[i:i + width]) for i in places.tolist()]
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = np.zeros(len(words) + 1, np.int32)
    starts = np.array([i for i, g in zip(places.tolist(), grams) if seen[g] > 1], np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(covered)[:-1]))


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def quality(docs: DataFrame, text: str = "text", keep=("doc_id",), bands=BANDS, chunk: int = CHUNK) -> DataFrame:
    """The columns ``keep`` (of type long) with the base features, ``kept`` and the ratios behind it."""
    def setup():
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        hashes, windows = WordHashes(), Windows()

        def judge(*cells):
            body = cells[-1] or b""
            words = body.split()
            n = len(words)
            chars = len(body.translate(None, SPACES).decode("utf-8", "replace"))
            symbols = sum(map(body.count, [SYMBOLS[i:i + 1] for i in range(len(SYMBOLS))]))
            repeats = repeated_words(words, hashes, windows)
            failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
            ratio = len(press(body)) / len(body) if body else 0.0
            bad = chunks = 0
            if len(body) > chunk:
                for at in range(0, len(body), chunk):
                    piece = body[at:at + chunk]
                    chunks += 1
                    bad += not in_band(len(piece), len(press(piece)) / len(piece), bands)
            good = bool(body) and in_band(len(body), ratio, bands) and bad <= BAD_CHUNKS * chunks
            yield (*cells[:-1], n, chars, symbols, duplicate_lines(body), repeats, failed, good and not failed,
                   ratio, chunks, bad)

        return judge

    return map_rows(docs.select(*keep, raw_text(text)), setup, [*zip(keep, repeat("long")), *COLUMNS])


@query("op6_quality_bands")
def op6_quality_bands(spark: SparkSession, sf: str) -> DataFrame:
    return quality(table(spark, sf, "documents"))
