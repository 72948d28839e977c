"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items and documents are read as normalised words (lower case, ASCII punctuation as white space). Every run of ``SEED``
words of an item is a seed, and so is every choice of four of five words in a row by ``GAPPED``, which an edited word between them
leaves intact: copies with every fourth or every third word replaced have no run of four. A first pass counts the items' words in
the whole corpus. A seed is rare if its words, drawn by
these frequencies, would hardly meet by chance; each item always keeps its rarer half of the runs and the rarest of every ``NEAR`` runs
in a row, so that no long passage is without one, and all of them if it is short. (How often the seed itself occurs would
not do: an item copied into a third of the corpus would lose its seeds.) A second pass cuts a passage around the rare seeds of
each document, as wide as the longest item of the seed on either side; a join on
the seeds pairs passages with items, and local alignment of the words scores each pair. The score of an item is the
alignment's score over that of a full match, so exact, edited and partial copies rank on one scale. A pair counts by its
share, but not below ``LEAST`` (a lone seed proves nothing), or by ``LONG`` words' score, however long the item is. An item
of six or seven words may differ by one word; shorter ones must match entirely.

The seeds go to the tasks in blocks of bounded size; a larger benchmark makes more passes, not larger tasks.

Null and empty texts or items give no seeds; an item shorter than a seed is one seed as a whole. Very long texts are read whole, and
only passages of them are shuffled. Repeated documents are each reported; per (doc_id, item_id) the best alignment is kept, of equal ones the
first by place. Other columns of either table, whatever their names, are not looked at. Empty tables give an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import Windows, WordHashes, map_rows, map_slices, mixed, raw_text
from .registry import query, table
from ..session import pinned

SEED = 4
GAPPED = ((0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))  # places of a gapped seed's words; shapes SEED + 1 and on
SPAN = 1 + max(map(max, GAPPED))
SEED_BLOCK = 1_000_000
RARE_SHARE = 1e-4  # expected chance occurrences of a rare seed, as a share of the documents
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.4
LEAST, LONG = 6 * MATCH, 13 * MATCH  # least score by share, and score that is enough by itself
SHORT = 8  # items of fewer words have seeds that one edited word leaves intact
NEAR = (LONG // MATCH - SEED + 2) // 2  # any LONG words hold so many seeds in a row from a multiple of it


def least_score(n: int, threshold: float = THRESHOLD) -> float:
    """Score at which an item of ``n`` words counts as found."""
    full = MATCH * n
    edited = full - MATCH + MISMATCH  # one word replaced
    if edited <= MATCH * SEED:
        return full
    return max(min(threshold * full, LONG), min(LEAST, edited))

_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))


def normal_words(text: bytes) -> list[bytes]:
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(_FOLD).split()


class Gaps:
    """Hashes of the gapped choices of words at every place: one row a shape of ``GAPPED``, empty if there are fewer words."""

    def __init__(self):
        self.factors = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(SEED)]
        self.codes = np.arange(SEED + 1, SEED + 1 + len(GAPPED), dtype=np.uint64)[:, None]

    def of(self, h: np.ndarray) -> np.ndarray:
        n = len(h) - SPAN + 1
        if n <= 0:
            return np.zeros((len(GAPPED), 0), np.uint64)
        scaled = [h * f for f in self.factors]
        return mixed(np.stack([sum(x[o:o + n] for x, o in zip(scaled, places)) for places in GAPPED])) ^ self.codes


class SeedFinder:
    """Where texts' words have given seeds, of shapes 1 to ``SEED`` (runs of so many words) or gapped."""

    def __init__(self, seeds: np.ndarray, reach: np.ndarray, shapes: list[int]):
        self.seeds, self.reach = seeds, reach  # sorted, unsigned, each with the words of its longest item
        self.widths, self.gapped = [s for s in shapes if s <= SEED], any(s > SEED for s in shapes)
        self.bits = np.zeros(1 << 22, np.bool_)
        self.bits[seeds >> np.uint64(42)] = True
        self.hashes, self.windows, self.gaps = WordHashes(), Windows(), Gaps()

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are seeds, and which seeds they are."""
        at = np.flatnonzero(self.bits[h >> np.uint64(42)])
        k = np.minimum(np.searchsorted(self.seeds, h[at]), len(self.seeds) - 1)
        same = self.seeds[k] == h[at] if len(self.seeds) else np.zeros(0, np.bool_)
        return at[same], k[same]

    def find(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, place, place behind and number of the seed of each hit, by place; ``ends`` is where texts end in ``h``."""
        found = []
        for width in self.widths:
            at, k = self.places(self.windows.of(h, width) ^ np.uint64(width))
            found.append((at, at + width, k))
        if self.gapped:
            rows = self.gaps.of(h)
            at, k = self.places(rows.ravel())
            at = at % max(1, rows.shape[1])
            found.append((at, at + SPAN, k))
        at, end, k = (np.concatenate(x) for x in zip(*found))
        text = np.searchsorted(ends, at, side="right")
        order = np.argsort(at, kind="stable")
        order = order[(end <= ends[text])[order]]  # a window over the edge of two texts is none
        return text[order], at[order], end[order], k[order]


def item_seeds(items: DataFrame, item_id: str = "item_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(item_id, words, n, shape, seed, parts, blocks) for each distinct seed of each item.

    ``parts`` are the hashes of its words, ``blocks`` the rows of ``NEAR`` places in which it occurs (none if gapped).
    """
    def setup():
        hashes, windows, gaps = WordHashes(), Windows(), Gaps()

        def fn(item, body):
            words = normal_words(body or b"")
            if words:
                n, whole = len(words), b" ".join(words)
                width = seed if n >= SHORT else n // 2 if least_score(n) < MATCH * n else min(seed, n)
                h = hashes.of(words)
                found, first, which = np.unique(windows.of(h, width) ^ np.uint64(width), return_index=True, return_inverse=True)
                blocks: list[set] = [set() for _ in found]
                for place, k in enumerate(which.tolist()):
                    blocks[k].add(place // NEAR)
                for s, at, where in zip(found.view(np.int64).tolist(), first.tolist(), blocks):
                    yield item, whole, n, width, s, h[at:at + width].view(np.int64).tolist(), sorted(where)
                if n >= SHORT:
                    for k, (row, places) in enumerate(zip(gaps.of(h), GAPPED)):
                        found, first = np.unique(row, return_index=True)
                        for s, at in zip(found.view(np.int64).tolist(), first.tolist()):
                            yield item, whole, n, SEED + 1 + k, s, h[at + np.array(places)].view(np.int64).tolist(), []

        return fn

    return map_rows(items.select(F.col(item_id).cast("string").alias("item_id"), raw_text(text)).distinct(), setup,
                    [("item_id", "string"), ("words", "binary"), ("n", "int"), ("shape", "int"), ("seed", "long"), ("parts", "array<long>"),
                     ("blocks", "array<long>")])


def _count_words(docs: DataFrame, text: str, wanted: np.ndarray) -> DataFrame:
    """(word, n) for the wanted word hashes that occur, and under null the number of all words."""
    def setup():
        finder = SeedFinder(wanted, wanted, [])

        def fn(columns):
            words = [w for body in columns[0] for w in normal_words(body or b"")]
            _, k = finder.places(finder.hashes.of(words))
            values, counts = np.unique(k, return_counts=True)
            yield None, len(words)
            yield from zip(wanted[values].view(np.int64).tolist(), counts.tolist())

        return fn

    return map_slices(docs.select(raw_text(text)), setup, [("word", "long"), ("n", "long")]).groupBy("word").agg(F.sum("n").alias("n"))


def _passages(docs: DataFrame, text: str, keep: tuple, seeds: np.ndarray, reach: np.ndarray, shapes: list[int]) -> DataFrame:
    """``keep`` (of type long), place of the first word, words, and the seeds of each passage."""
    def setup():
        finder = SeedFinder(seeds, reach, shapes)

        def fn(columns):
            *kept, bodies = columns
            texts = [normal_words(body or b"") for body in bodies]
            ends = np.cumsum([len(words) for words in texts])
            text, at, end, k = finder.find(finder.hashes.of(list(chain.from_iterable(texts))), ends)
            if not len(at):
                return
            wide = finder.reach[k]
            far = at[1:] - np.maximum.accumulate(end)[:-1] > np.maximum(wide[1:], wide[:-1])
            for part in np.split(np.arange(len(at)), np.flatnonzero(far | (text[1:] != text[:-1])) + 1):
                row, words = int(text[part[0]]), texts[text[part[0]]]
                begin = int(ends[row]) - len(words)
                start, stop = max(0, int((at[part] - wide[part]).min()) - begin), int((end[part] + wide[part]).max()) - begin
                yield (*[c[row] for c in kept], start, b" ".join(words[start:stop]), np.unique(seeds[k[part]]).view(np.int64).tolist())

        return fn

    return map_slices(docs.select(*keep, raw_text(text)), setup,
                      [*((k, "long") for k in keep), ("start", "long"), ("passage", "binary"), ("seeds", "array<long>")])


def align(item: list, passage: list) -> tuple[int, int, int]:
    """Best local alignment score of two word lists and its range in the passage, ends exclusive."""
    numbers: dict = {}
    x = [numbers.setdefault(w, len(numbers)) for w in item]
    y = np.array([numbers.get(w, -1) for w in passage], np.int64)
    n = len(y)
    steps = np.arange(n + 1) * -GAP
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in x:
        score = np.where(y == w, MATCH, MISMATCH)
        moved, from_ = np.zeros(n + 1, np.int64), np.arange(n + 1)
        diagonal, above = row[:-1] + score, row[1:] + GAP
        take = np.maximum(diagonal, above)
        up = take > 0
        moved[1:][up] = take[up]
        from_[1:][up] = np.where(diagonal >= above, begin[:-1], begin[1:])[up]
        # A gap in the item carries the best earlier cell along; running maxima find which.
        lifted = moved + steps
        top = np.maximum.accumulate(lifted)
        origin = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row = top - steps
        begin = from_[origin]
        k = int(row.argmax())
        if row[k] > best[0]:
            best = int(row[k]), int(begin[k]), k
    return best


def alignments(pairs: DataFrame, keep: tuple, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (keep.., start, item_id, words, passage) that align well enough."""
    def setup():
        scored = lru_cache(4096)(lambda item, passage: align(item.split(), passage.split()))

        def fn(*cells):
            *kept, start, item, words, passage = cells
            score, a, b = scored(words, passage)
            full = MATCH * (words.count(b" ") + 1)
            if score >= least_score(full // MATCH, threshold):
                yield (*kept, item, score / full, start + a, start + b)

        return fn

    return map_rows(pairs.select(*keep, "start", "item_id", "words", "passage"), setup,
                    [*((k, "long") for k in keep), ("item_id", "string"), ("share", "double"), ("first_word", "long"), ("end_word", "long")])


def rare_seeds(found: DataFrame, counts: DataFrame, n_docs: int) -> DataFrame:
    """The seeds of ``found`` whose words seldom meet by chance, the rarer half of each item's runs and the rarest of each of its
    blocks, and all seeds of short items."""
    total = float(counts.where("word is null").agg(F.max("n")).first()[0] or 1)
    each = found.select("item_id", "words", "n", "shape", "seed", "blocks", F.explode("parts").alias("word")).join(
        counts.withColumnRenamed("n", "_n"), "word", "left").groupBy("item_id", "words", "n", "shape", "seed", "blocks").agg(
        (F.sum(F.log(F.coalesce("_n", F.lit(0.5)) / total)) + F.log(F.lit(total))).alias("_chance"))
    run = F.col("shape") <= SEED
    item = W.partitionBy("item_id", "words", run)
    ranked = each.withColumns({"_rank": F.row_number().over(item.orderBy("_chance", "seed")), "_of": F.count(F.lit(1)).over(item)})
    near = ranked.withColumn("block", F.explode_outer("blocks")).withColumn(
        "_near", F.row_number().over(W.partitionBy("item_id", "words", run, "block").orderBy("_chance", "seed")))
    limit = F.log(F.lit(max(1.0, RARE_SHARE * n_docs)))
    kept = (F.col("_chance") <= limit) | (F.col("n") < SHORT) | (run & ((F.col("_rank") * 2 <= F.col("_of") + 1) | (F.col("_near") == 1)))
    return near.where(kept).select("item_id", "words", "n", "seed").distinct()


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", keep=("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` (of type long), item_id, share, first_word and end_word (of the normalised words) of every match."""
    keep = tuple(keep)
    seeds = pinned(item_seeds(items), "bench-seeds")
    n_docs = docs.count()
    blocks = max(1, -(-seeds.count() // SEED_BLOCK))
    block = F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks))
    out = None
    for k in range(blocks):
        mine = seeds.where(block == k)
        shapes = sorted(mine.agg(F.collect_set("shape")).first()[0])
        if not shapes:
            continue
        wanted = _hashes(mine.select(F.explode("parts").alias("seed")))
        counts = pinned(_count_words(docs, text, wanted), "bench-words")
        item, passage = F.xxhash64("item_id", "words").alias("item"), F.xxhash64(*keep, "start", "passage").alias("place")
        rare = pinned(rare_seeds(mine, counts, n_docs).select("seed", "n", item), "bench-rare")
        passages = pinned(_passages(docs, text, keep, *_reaches(rare), shapes).select("*", passage), "bench-passages")
        # Pairs are found by numbers alone; texts are joined to each pair once.
        met = passages.select("place", F.explode("seeds").alias("seed")).join(rare.select("seed", "item"), "seed").select("place", "item").distinct()
        pairs = met.join(passages.drop("seeds"), "place").join(mine.select("item_id", "words", item).distinct(), "item")
        found = alignments(pairs, keep, threshold)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = alignments(_none(docs, keep), keep)
    return out.groupBy(*keep, "item_id").agg(F.min_by(F.struct("share", "first_word", "end_word"), F.struct(-F.col("share"), "first_word")).alias("best")
                                             ).select(*keep, "item_id", "best.*")


def _hashes(seeds: DataFrame) -> np.ndarray:
    """At most a block of seeds, or of their words, sorted."""
    return np.sort(seeds.select("seed").distinct().toArrow().column("seed").to_numpy().astype(np.int64).view(np.uint64))


def _reaches(rare: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most a block of seeds, sorted, and the number of words of the longest item of each."""
    found = rare.groupBy("seed").agg(F.max("n").alias("n")).toArrow()
    seeds, n = (found.column(c).to_numpy().astype(np.int64) for c in ("seed", "n"))
    order = np.argsort(seeds.view(np.uint64))
    return seeds.view(np.uint64)[order], n[order]


def _none(docs: DataFrame, keep: tuple) -> DataFrame:
    lit: dict[str, Column] = {"start": F.lit(0).cast("long"), "item_id": F.lit(""), "words": F.lit(b""), "passage": F.lit(b"")}
    return docs.limit(0).select(*keep).withColumns(lit)


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that match no item, with their own columns."""
    mark = F.xxhash64("text").alias("_mark")
    bad = pinned(contaminated(docs.select("doc_id", "text", mark), items, keep=("doc_id", "_mark"), threshold=threshold).select(
        "doc_id", "_mark").distinct(), "bench-bad").alias("b")
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", mark).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d._mark") == F.col("b._mark"))
    return rows.join(bad, same, "left_anti").select("doc.*")


@query("op1_decontaminate")
def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
