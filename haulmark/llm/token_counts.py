"""Token counts by overlap resynchronisation.

A huge text is cut into chunks that overlap. Each chunk is encoded on its own with character offsets; near a cut that
no rule protects the two encodings may differ, so neighbours are spliced at a position inside their overlap where both
have a token start and where a piece of the pre-tokenizer must start whatever surrounds it (``bpe.stable_at``). Left of
it the first encoding counts, right of it the second. If an overlap holds no such position it is doubled, at last up to
the end of the text, and the first chunk is encoded again. The result equals that of the whole text.

A null text counts as empty: 0 bytes, 0 tokens. Each row is counted alone; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession

from .bpe import Encoder, stable_at, tokenizer_path
from .common import map_rows, raw_text
from .registry import query, table

CHUNK, OVERLAP, HUGE = 16_384, 256, 32_768
LIMIT = 512


def _starts(encoder: Encoder, texts: list[str], at: list[int]) -> list[list[int]]:
    """Per text, the source position at which each of its tokens starts."""
    return [[a + p for p, _ in e.offsets] for a, e in zip(at, encoder.encode(texts))]


def common_boundary(text: str, left: list[int], right: list[int], low: int, high: int) -> int | None:
    """The first stable position in (low, high) at which a token of either encoding starts."""
    there = set(right[:bisect_left(right, high)])
    for p in left[bisect_left(left, low + 1):bisect_left(left, high)]:
        if p in there and stable_at(text, p) and p + 1 < high:
            return p
    return None


def spliced_count(encoder: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text without special strings, from overlapping chunks."""
    n = len(text)
    at = list(range(0, n, chunk))
    ends = [min(n, a + chunk + overlap) for a in at]
    total, cut, k = 0, 0, 0
    starts: dict[int, list[int]] = {}
    while True:
        for i in range(k, min(k + 8, len(at))):  # a few chunks at a time: memory stays bounded
            if i not in starts:
                starts[i] = _starts(encoder, [text[at[i]:ends[i]]], [at[i]])[0]
        if ends[k] >= n:
            return total + len(starts[k]) - bisect_left(starts[k], cut)
        nxt = k + 1
        while ends[nxt] <= ends[k] and nxt + 1 < len(at):  # a widened overlap may pass whole chunks
            nxt += 1
        if nxt not in starts:
            starts[nxt] = _starts(encoder, [text[at[nxt]:ends[nxt]]], [at[nxt]])[0]
        found = common_boundary(text, starts[k], starts[nxt], max(at[nxt], cut), ends[k])
        if found is None:
            ends[k] = min(n, ends[k] + max(overlap, ends[k] - at[k]))
            starts[k] = _starts(encoder, [text[at[k]:ends[k]]], [at[k]])[0]
            continue
        total += bisect_left(starts[k], found) - bisect_left(starts[k], cut)
        for i in range(k, nxt):
            starts.pop(i, None)
        cut, k = found, nxt


def count_tokens(encoder: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, huge: int = HUGE) -> int:
    """``encoder`` must have been made with ``value=len``."""
    if len(text) <= huge or not encoder.by_unit:
        return sum(encoder.values(text))
    parts = encoder.cut.split(text) if encoder.cut else [text]
    return sum(1 if p in encoder.special else spliced_count(encoder, p, chunk, overlap) for p in parts if p)


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", keep=("doc_id",), limit: int = LIMIT) -> DataFrame:
    """``keep`` (of type long), ``n_bytes``, ``n_tokens`` and ``over_limit`` for a .json (tokenizers) or .model
    (sentencepiece) file; the latter is encoded whole."""
    def setup():
        if tokenizer.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(tokenizer))
            count = lambda t: len(pieces.encode(t, num_threads=1)) if t else 0
        else:
            encoder = Encoder.of(tokenizer_path(tokenizer), len)
            count = lambda t: count_tokens(encoder, t)

        def row(*cells):
            body = cells[-1] or b""
            n = count(body.decode("utf-8", "replace"))
            yield (*cells[:-1], len(body), n, n > limit)

        return row

    schema = [*((k, "long") for k in keep), ("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")]
    return map_rows(docs.select(*keep, raw_text(text)), setup, schema)


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"), "byte_bpe_50k.json")
