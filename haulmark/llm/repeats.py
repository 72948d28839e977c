"""Repeated spans by compaction of a de Bruijn graph.

The graph's edges are the windows of ``WINDOW`` consecutive words, between their overlaps of one word less. Edges are not
handled one by one:

1. *Pieces.* Consecutive windows that share their minimizer (the ``KMER`` words of least hash inside them) are one piece, and are
   kept as the hash of the whole stretch. Equal windows have equal minimizers, so only pieces under one minimizer can share
   windows. Minimizers found in one document only go at once; they are most of a corpus.
2. *Classes.* Equal pieces are one class with the least document that holds it and its place there. A minimizer with one class
   does not branch: its windows all have that least document. Where it branches, the windows of each class are read once, at
   the class's source coordinates, checked against the stretch's hash, and joined by their own hashes.
3. *Paths.* Classes that do not branch, each the only one to follow the other, are compacted into paths by contraction joins
   (``components``). A document's pieces on a path, at one distance from the path's source, are one span if they are gapless;
   the lengths verify that.
4. *Removal.* A word goes if a window over it is also in a document of smaller id. Windows are judged on the input.

Everything is grouped by hashes of content and pre-aggregated, so passages in many documents shuffle one row per task.

Null and empty texts, and texts shorter than a window, lose nothing. A null id counts as the greatest. Rows that share an id do not
remove from one another, whether equal or not. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import pinned
from ..skew import split_hot_join
from .common import WORD, Windows, WordHashes, map_rows, raw_text
from .components import components
from .registry import query, table

WINDOW = 50
KMER = 12
LAST = (1 << 63) - 1
HOT_PIECES = 50_000  # equal pieces from which their join is split
_SPAN_BASE = 0xC2B2AE3D27D4EB4F


class PieceCutter:
    """Pieces of one text at a time, as arrays."""

    def __init__(self, window: int = WINDOW, kmer: int = KMER):
        if not 0 <= window - kmer < 63:
            raise ValueError("a piece has at most 63 windows")
        self.window, self.kmer = window, kmer
        self.hashes, self.grams, self.stretches = WordHashes(), Windows(), Windows(_SPAN_BASE)

    def cut(self, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Minimizer, stretch hash, first window and number of windows of each piece."""
        n = len(h) - self.window + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none.astype(np.uint64), none, none
        g = self.grams.of(h, self.kmer)
        width = self.window - self.kmer + 1
        at = np.concatenate([np.lib.stride_tricks.sliding_window_view(g[i:i + 65_536 + width - 1], width).argmin(axis=1) + i
                             for i in range(0, n, 65_536)]) if n else np.zeros(0, np.int64)
        at = at + np.arange(n) - np.repeat(np.arange(0, n, 65_536), np.minimum(65_536, n - np.arange(0, n, 65_536)))
        start = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        count = np.diff(np.append(start, n))
        return g[at[start]], self.stretches.spans(h, start, start + count + self.window - 1), start, count


def _key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc")


def _mark(text: str) -> Column:
    """Tells rows apart that share an id."""
    return F.xxhash64(F.lit(5), F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("mark")


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(mini, span, start, n, doc, mark) of every piece."""
    schema = pa.schema([("mini", pa.int64()), ("span", pa.int64()), ("start", pa.int32()), ("n", pa.int8()), ("doc", pa.int64()), ("mark", pa.int64())])

    def run(batches):
        cutter = PieceCutter(window, kmer)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                parts = []
                for doc, mark, body in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns)):
                    mini, span, start, n = cutter.cut(cutter.hashes.of((body or b"").split()))
                    if len(n):
                        parts.append((mini.view(np.int64), span.view(np.int64), start.astype(np.int32), n.astype(np.int8),
                                      np.full(len(n), doc), np.full(len(n), mark, np.int64)))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], schema=schema)

    return docs.select(_key(doc_id), _mark(text), raw_text(text)).mapInArrow(run, "mini long, span long, start int, n byte, doc long, mark long")


def _branching_windows(docs: DataFrame, branching: DataFrame, window: int, kmer: int) -> DataFrame:
    """(mini, span, offset, gram) for each window of each branching class, read at its source."""
    asked = branching.groupBy("src.doc", "src.mark").agg(F.collect_list(F.struct("mini", "span", "src.start", "n")).alias("asked"))
    texts = docs.select(_key("doc_id"), _mark("text"), raw_text("text"))

    def setup():
        cutter = PieceCutter(window, kmer)

        def fn(body, wanted):
            h = cutter.hashes.of((body or b"").split())
            grams = cutter.grams.of(h, window).view(np.int64)
            start = np.array([a["start"] for a in wanted])
            n = np.array([a["n"] for a in wanted])
            ok = start + n + window - 1 <= len(h)
            span = np.zeros(len(n), np.int64)
            span[ok] = cutter.stretches.spans(h, start[ok], (start + n + window - 1)[ok]).view(np.int64)
            for a, there in zip(wanted, span.tolist()):
                if there == a["span"]:
                    for i, gram in enumerate(grams[a["start"]:a["start"] + a["n"]].tolist()):
                        yield a["mini"], a["span"], i, gram

        return fn

    return map_rows(texts.join(asked, ["doc", "mark"]).select("text", "asked"), setup,
                    [("mini", "long"), ("span", "long"), ("offset", "int"), ("gram", "long")])


def repeated_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(doc, mark, start, n, bits): runs of ``n`` windows from ``start`` that smaller documents hold too.

    ``bits`` marks which of the windows do; null means all. ``doc`` is the id, ``LAST`` for null.
    """
    cut = pieces(docs, window=window, kmer=kmer)
    shared = cut.groupBy("mini").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("mini")
    shared = pinned(shared, "repeat-minis")
    found = pinned(cut.join(shared, "mini", "left_semi"), "repeat-pieces")
    where = F.struct("doc", "mark", "start")
    classes = found.groupBy("mini", "span", "n").agg(F.min(where).alias("src"), F.max("doc").alias("most"))
    forks = classes.groupBy("mini").agg(F.count(F.lit(1)).alias("classes"))
    classes = pinned(classes.join(forks, "mini"), "repeat-classes")

    # Where the path forks, windows are judged one by one.
    branching = classes.where("classes > 1")
    grams = pinned(_branching_windows(docs, branching, window, kmer), "repeat-grams").join(
        branching.select("mini", "span", F.col("src.doc").alias("first"), "most"), ["mini", "span"])
    least = grams.groupBy("mini", "gram").agg(F.min("first").alias("least"))
    judged = grams.join(least, ["mini", "gram"]).where("least < most").groupBy("mini", "span").agg(
        F.collect_list(F.struct("least", "offset")).alias("windows"))
    one_bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["offset"])
    bits = F.aggregate("windows", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.when(x["least"] < F.col("doc"), one_bit(x)).otherwise(F.lit(0).cast("long"))))
    # A passage of very many documents is one key here, so heavy keys are joined apart.
    at_forks = split_hot_join(found, pinned(judged, "repeat-judged"), ["mini", "span"], floor=HOT_PIECES).select("doc", "mark", "start", F.col("n").cast("int").alias("n"), bits.alias("bits")).where("bits <> 0")

    # Elsewhere classes follow one another along paths.
    straight = classes.where("classes = 1 and src.doc < most").select("mini", "src")
    along = pinned(found.join(straight, "mini").select(
        F.col("mini").alias("node"), "doc", "mark", "start", F.col("n").cast("int").alias("n"), F.col("src.doc").alias("first"),
        (F.col("start") - F.col("src.start")).alias("shift")), "repeat-straight")
    follows = along.select(F.col("node").alias("a"), "doc", "mark", (F.col("start") + F.col("n")).alias("start")).join(
        along.select(F.col("node").alias("b"), "doc", "mark", "start"), ["doc", "mark", "start"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
    follows = pinned(follows, "repeat-follows")
    only = follows.join(follows.groupBy("a").agg(F.count(F.lit(1)).alias("out")), "a").join(
        follows.groupBy("b").agg(F.count(F.lit(1)).alias("in")), "b").where("out = 1 and in = 1")
    paths = pinned(components(only.select("a", "b")), "repeat-paths")
    on_paths = along.where("doc > first").join(paths, "node", "left").groupBy(
        "doc", "mark", "shift", "first", F.coalesce("root", "node").alias("path")).agg(
        F.min("start").alias("low"), F.max(F.col("start") + F.col("n")).alias("high"), F.sum("n").alias("sum"),
        F.collect_list(F.struct("start", "n")).alias("parts"))
    gapless = F.array(F.struct(F.col("low").alias("start"), (F.col("high") - F.col("low")).alias("n")))
    spans = on_paths.select("doc", "mark", F.explode(F.when(F.col("high") - F.col("low") == F.col("sum"), gapless).otherwise(F.col("parts"))).alias("s"))
    return at_forks.unionByName(spans.select("doc", "mark", "s.start", "s.n", F.lit(None).cast("long").alias("bits")))


def without_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    spans = repeated_spans(docs, window, kmer)
    lists = pinned(spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "n", "bits")).alias("spans")), "repeat-spans")
    rows = docs.select("doc_id", _key("doc_id"), _mark("text"), raw_text("text")).join(lists, ["doc", "mark"], "left")

    def setup():
        def fn(doc_id, body, spans):
            words = (body or b"").split()
            if spans:
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    if s["bits"] is None:
                        edge[s["start"]] += 1
                        edge[s["start"] + s["n"] + window - 1] -= 1
                    else:
                        for i in range(s["n"]):
                            if s["bits"] >> i & 1:
                                edge[s["start"] + i] += 1
                                edge[s["start"] + i + window] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            else:
                kept = words
            yield doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

        return fn

    return map_rows(rows.select("doc_id", "text", "spans"), setup,
                    [("doc_id", "long"), ("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string")])


# Every window by its words; rows are told apart by number, so that rows that share an id keep their own words.
REPEATS_SQL = f"""with rows as (
    select row_number() over () as row, doc_id, coalesce(doc_id, {LAST}) as doc, regexp_extract_all(coalesce(text, ''), '{WORD}') as words from documents),
  windows as (
    select row, doc, start, sha256(array_to_string(words[start:start + {WINDOW - 1}], ' ')) as w
    from rows, unnest(range(1, len(words) - {WINDOW - 2})) as t(start)),
  leasts as (select w, min(doc) as least from windows group by w),
  gone as (
    select distinct row, start + k as place from windows join leasts using (w), unnest(range(0, {WINDOW})) as s(k) where doc > least),
  each as (select row, place, words[place] as word from rows, unnest(range(1, len(words) + 1)) as t(place)),
  kept as (
    select row, count(*) as n, string_agg(word, ' ' order by place) as words from each anti join gone using (row, place) group by row)
select doc_id, len(rows.words) as n_words, len(rows.words) - coalesce(n, 0) as n_removed, sha256(coalesce(kept.words, '')) as kept_sha256
from rows left join kept using (row)"""


@query("op9_repeated_spans", REPEATS_SQL)
def op9_repeated_spans(spark: SparkSession, sf: str) -> DataFrame:
    return without_repeats(table(spark, sf, "documents"))
