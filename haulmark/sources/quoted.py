"""Records of quoted files whose fields hold line breaks, read by many tasks.

Where a split begins nobody knows whether a quote is open. So a first pass finds, for each split and for either answer, whether
one is open at its end; a scan over the splits of a file, one row each, gives the true answers; and a second pass cuts
records. A record that crosses splits leaves a piece in each, and only these pieces are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import pinned
from ..settings import LoadSetting

# Up to so many splits at whose edges a record crosses are broadcast (some 100 bytes each); beyond it they are joined.
BROADCAST_SPLITS = 200_000
_EDGE = "source string, block long, inside boolean, owner long, open boolean"


def quote_scanner(delimiter: str, quote: str, escape: str) -> Callable[[str, bool], bool]:
    """``scan(line, inside)``: whether a quote is open at the end of a line, given whether one is at its start.

    A quote opens only at the start of a field; what follows a closing quote up to the delimiter is data.
    """
    q, e = re.escape(quote), re.escape(escape)
    body = re.compile(f"(?:[^{q}]|{q}{q})*" if quote == escape else f"(?:[^{q}{e}]|{e}.)*", re.S)

    def scan(line: str, inside: bool) -> bool:
        if quote not in line:
            return inside
        at = 0
        while True:
            if inside:
                at = body.match(line, at).end()
                if at >= len(line) or line[at] != quote:  # an escape at the end of the line escapes its break
                    return True
                at = line.find(delimiter, at + 1)
            elif line.startswith(quote, at):
                inside, at = True, at + 1
                continue
            else:
                at = line.find(delimiter, at)
            if at < 0:
                return False
            inside, at = False, at + 1

    return scan


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], fields: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)


def split_states(lines: DataFrame, scan: Callable[[str, bool], bool]) -> DataFrame:
    """Per split: whether a quote is open at its end if none (``after_out``) or one (``after_in``) is at its start, and whether
    in the latter case a record starts in it."""
    fields = pa.schema([("source", pa.string()), ("block", pa.int64()), ("after_out", pa.bool_()), ("after_in", pa.bool_()), ("starts", pa.bool_())])

    def run(batches):
        def rows():
            split, out, inside, starts = None, False, True, False
            for value, source, block in _lines(batches):
                if (source, block) != split:
                    if split:
                        yield (*split, out, inside, starts)
                    split, out, inside, starts = (source, block), False, True, False
                starts = starts or not inside
                if out == inside:  # the answers have met and stay together
                    out = inside = scan(value, out)
                else:
                    out, inside = scan(value, out), scan(value, inside)
            if split:
                yield (*split, out, inside, starts)

        yield from _batches(rows(), fields)

    return lines.select("value", "source", "block").mapInArrow(run, "source string, block long, after_out boolean, after_in boolean, starts boolean")


def true_states(states: DataFrame) -> DataFrame:
    """Of each split at whose edge a record crosses: is a quote open at its start and end, and which split began the record."""
    def scan(group):
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        out, inside, owner = [], False, 0
        for r in rows:
            after = r["after_in"] if inside else r["after_out"]
            if inside or after:
                out.append((r["source"], r["block"], inside, owner, after))
            if not inside or r["starts"]:
                owner = r["block"]
            inside = after
        names = ["source", "block", "inside", "owner", "open"]
        types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]
        return pa.table({n: pa.array(list(c), t) for n, t, c in zip(names, types, zip(*out) if out else [[]] * 5)})

    return states.groupBy("source").applyInArrow(scan, _EDGE)  # a row a split of one file


def _cut(lines: DataFrame, scan: Callable[[str, bool], bool], pieces: bool, skip: int) -> DataFrame:
    """Whole records (value, source, block), or only the pieces of records that cross splits, with the split that began each."""
    fields = pa.schema([("value", pa.string()), ("source", pa.string()), ("block", pa.int64()), ("owner", pa.int64())])

    def run(batches):
        def rows():
            split, state, held, begun, number, owner, goes_on = None, False, [], False, 0, 0, False

            def flush(last: bool):
                """What is held: a record that began here and ends here, or a piece of one that crosses an edge."""
                crosses = not begun or (last and goes_on)
                first = split[1] if begun else owner
                dropped = first == 0 and begun and number <= skip
                if held and not dropped and crosses == pieces:
                    yield "\n".join(held), *split, first

            for value, source, block, inside, before, open_ in _lines(batches):
                if (source, block) != split:
                    if split:
                        yield from flush(True)
                    split, state, held, begun, number = (source, block), bool(inside), [], False, 0
                    owner, goes_on = before, bool(open_)
                if not state:
                    yield from flush(False)
                    held, begun, number = [], True, number + 1
                held.append(value)
                state = scan(value, state)
            if split:
                yield from flush(True)

        yield from _batches(rows(), fields)

    return lines.select("value", "source", "block", "inside", "owner", "open").mapInArrow(run, "value string, source string, block long, owner long")


def quoted_records(spark: SparkSession, path: str | Sequence[str], setting: LoadSetting = LoadSetting()) -> DataFrame:
    """(value, source, block): the records of quoted files, line breaks inside quotes included, in any number of splits.

    The file is read for the states, for the records, and once more (outside Python) for the few splits at whose edges
    records cross. The first ``skip_rows`` records of each file are dropped; they must begin in the file's first split.
    """
    scan = quote_scanner(setting.delimiter, setting.quotechar, setting.escapechar)
    lines = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path)).select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"))
    edges = pinned(true_states(split_states(lines, scan)), "quote-edges")
    few = edges.count() <= BROADCAST_SPLITS
    on = ["source", "block"]

    def with_edges(how: str) -> DataFrame:
        if few:  # lines stay where they are, in order
            return lines.join(F.broadcast(edges), on, how)
        numbered = lines.withColumn("_at", F.monotonically_increasing_id())
        return numbered.join(edges, on, how).repartition(*on).sortWithinPartitions(*on, "_at")

    whole = _cut(with_edges("left"), scan, False, setting.skip_rows).select("value", "source", "block")
    parts = _cut(with_edges("inner"), scan, True, setting.skip_rows)
    skipped = F.lit(setting.skip_rows > 0) & (F.col("owner") == 0) & (F.min("block") > 0)  # its beginning was dropped
    joined = parts.groupBy("source", "owner").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda p: p["value"]), "\n").alias("value"),
        skipped.alias("_skipped")).where("not _skipped")
    return whole.unionByName(joined.select("value", "source", F.col("owner").alias("block")))
