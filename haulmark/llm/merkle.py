"""Merkle manifest of a table by slot pivots.

Leaves are numbered inside their source by a range sort: a task numbers its own rows, and the rows before it come from sums over
one row a task and source. From there each level is one aggregate: the ``FANOUT`` children of a parent are spread over as
many columns by conditional aggregates, their concatenation is hashed for the parent, and the same columns without the own
slot are the siblings. A source's last node is its subroot, and the subroots make a tree of their own by the same steps.
Proofs are handed down: a node's steps (what stands before and after it at each level above) go to its children by a join
on (source, parent), so the widest rows are one a parent, never one a leaf, until the last step hashes them.

A null source is a source of its own, first in order. A null id counts as the empty text where ids are hashed and comes
first in its source. Rows that share an id are ordered by their leaf, so that repeated rows, which have equal leaves, take
neighbouring places and reruns agree on the rows as a whole. Texts of any length are hashed whole, null and empty ones differ.
Extra columns are neither hashed nor returned, whatever their names. An empty table gives an empty result. A source may
hold any share of the rows: ranges cut through it.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import pinned
from .common import id_mod
from .registry import query, table

FANOUT = 16
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def numbered(rows: DataFrame, group: Sequence[str], by: Sequence[str], label: str) -> DataFrame:
    """``rows`` with ``pos``, their place in their group from 0 in the order ``by``, and ``n``, the group's size.

    A range sort; the places before a task's rows are sums over one row for each task and group.
    """
    order = [F.col(c).asc_nulls_first() for c in (*group, *by)]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # An id that grows by one a row inside a partition, with the partition's number in its upper 31 bits.
    placed = pinned(sorted_.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), label)
    counts = placed.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_low"))
    keyed = ", ".join(f"`{c}`" for c in group)
    inside = f"PARTITION BY {keyed}" if group else ""
    counts = counts.select(
        "*", F.expr(f"sum(_rows) OVER ({inside} ORDER BY _part)").alias("_upto"), F.expr(f"sum(_rows) OVER ({inside})").alias("n"))
    starts = counts.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_{c}") for c in group), "n",
                           (F.col("_upto") - F.col("_rows") - F.col("_low")).alias("_shift"))
    on = F.col("_part") == F.col("_p")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return placed.join(starts, on).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def _slots(fanout: int) -> list[str]:
    return [f"slot{i}" for i in range(fanout)]


def pivoted(nodes: DataFrame, group: Sequence[str], fanout: int, carried: Sequence[str] = ()) -> DataFrame:
    """One row a parent of ``nodes`` (group, pos, n, hash, carried): its children by slot, their number, and its own hash.

    A child is (hash, carried...); a group's only node is its own parent, unhashed.
    """
    child = ", ".join(("hash", *carried))
    each = [F.expr(f"max(struct({child})) FILTER (WHERE pos % {fanout} = {i}) AS {s}") for i, s in enumerate(_slots(fanout))]
    out = nodes.groupBy(*group, F.expr(f"pos div {fanout}").alias("parent")).agg(F.max("n").alias("n"), *each)
    joined = ", ".join(f"{s}.hash" for s in _slots(fanout))
    return out.withColumn("node", F.expr(f"if(n = 1, slot0.hash, sha2(binary(concat_ws('', {joined})), 256))"))


def _children(fanout: int) -> Column:
    """The children of a pivoted row, each with its slot and with what stands beside it; a lone node has no step."""
    slots = _slots(fanout)
    side = lambda names: f"concat_ws('', {', '.join(f'{s}.hash' for s in names)})" if names else "''"
    each = ", ".join(
        f"CASE WHEN {s} IS NOT NULL THEN named_struct('slot', {i}, 'child', {s}, 'step', "
        f"slice(array(named_struct('before', {side(slots[:i])}, 'after', {side(slots[i + 1:])})), 1, int(n > 1))) END" for i, s in enumerate(slots))
    return F.expr(f"filter(array({each}), x -> x IS NOT NULL)")


def tree(leaves: DataFrame, group: Sequence[str], by: Sequence[str], label: str, fanout: int = FANOUT,
         carried: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Levels of pivoted parents from the leaves (group, hash, carried..., by...) up, and (group, hash) of the last nodes."""
    nodes = numbered(leaves, group, by, f"{label}-leaves")
    levels = []
    while True:
        level = pinned(pivoted(nodes, group, fanout, () if levels else carried), f"{label}-level")
        levels.append(level)
        nodes = level.select(*group, F.col("parent").alias("pos"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.col("node").alias("hash"))
        if nodes.where("n > 1").isEmpty():
            return levels, nodes.select(*group, "hash")


def handed_down(levels: Sequence[DataFrame], tops: DataFrame, group: Sequence[str], fanout: int, carried: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """(group, hash, carried, kept, path) of every leaf: ``path`` lists its steps from its own level through those of ``tops``.

    ``tops`` (group, kept, path) has one row a group.
    """
    above = tops.withColumn("pos", F.lit(0).cast("long"))
    for i, level in reversed(list(enumerate(levels))):
        also = carried if i == 0 else ()
        up = above.select(*(F.col(c).alias(f"_{c}") for c in group), F.col("pos").alias("_pos"), *kept, "path")
        on = F.col("parent") == F.col("_pos")
        for c in group:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        child = level.join(up, on).select(*group, "parent", *kept, "path", F.explode(_children(fanout)).alias("c"))
        above = child.select(*group, (F.col("parent") * fanout + F.col("c.slot")).alias("pos"), "c.child.hash",
                             *(f"c.child.{c}" for c in also), *kept, F.concat("c.step", "path").alias("path"))
    return above


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    parts = {c: framed(F.col(c)) for c in LEAF_COLUMNS}
    altered = digest(*({**parts, "text": framed(lowered)}.values()))
    leaves = docs.select("doc_id", "source", digest(*parts.values()).alias("hash"), F.when(id_mod("doc_id", 5) == 0, altered).alias("altered"))
    inner, subroots = tree(leaves, ["source"], ["doc_id", "hash"], "merkle-documents", fanout, ["doc_id", "altered"])
    outer, root = tree(subroots, [], ["source"], "merkle-sources", fanout, ["source"])
    empty = F.array().cast("array<struct<before:string,after:string>>").alias("path")
    tops = handed_down(outer, root.select(F.col("hash").alias("root"), empty), [], fanout, ["source"], ["root"])
    tops = pinned(tops.select("source", F.col("hash").alias("subroot"), "root", "path"), "merkle-subroots")
    rows = handed_down(inner, tops, ["source"], fanout, ["doc_id", "altered"], ["subroot", "root"])
    beside = F.concat_ws("", F.transform("path", lambda s: F.concat(s["before"], s["after"])))
    folded = F.aggregate("path", F.coalesce("altered", "hash"), lambda h, s: digest(s["before"], h, s["after"]))
    out = rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", digest(beside).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _framed_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


_LEAF_SQL = "sha256(" + " || ".join(f"({_framed_sql(c)})" for c in LEAF_COLUMNS[:-1]) + " || ({}))"

SQL_CHECK = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_LEAF_SQL.format(_framed_sql('text'))} AS leaf,
         {_LEAF_SQL.format(_framed_sql(f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"))} AS lowered
  FROM documents),
sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS grp FROM (SELECT DISTINCT source FROM documents)),
placed AS (
  SELECT doc_id, s.grp, row_number() OVER (PARTITION BY s.grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY s.grp) AS n,
         leaf, lowered FROM leaves l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source),
inner_nodes AS (
  SELECT grp, 0 AS lvl, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT grp, lvl + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM inner_nodes WHERE n > 1 GROUP BY grp, lvl, pos // 16),
subroots AS (SELECT grp, h, lvl FROM inner_nodes WHERE n = 1),
outer_nodes AS (
  SELECT 0 AS lvl, grp - 1 AS pos, count(*) OVER () AS n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM outer_nodes WHERE n > 1 GROUP BY lvl, pos // 16),
runs AS (
  SELECT i.grp, i.lvl, i.pos // 16 AS parent, list(i.h ORDER BY i.pos) AS hs FROM inner_nodes i WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT 0, lvl, pos // 16, list(h ORDER BY pos) FROM outer_nodes WHERE n > 1 GROUP BY ALL),
crc_bits AS (SELECT b, list_reduce([b, 0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(b)),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM crc_bits),
marked AS (
  SELECT row_number() OVER () AS k, p.*, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in regexp_extract_all(coalesce(doc_id::VARCHAR, ''), '.')]),
                              lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295::BIGINT) % 5 = 0 AS tampered
  FROM placed p, crc_table),
folded AS (
  SELECT k, grp, 0 AS lvl, pos, CASE WHEN tampered THEN lowered ELSE leaf END AS h, '' AS proof FROM marked
  UNION ALL
  SELECT k, CASE WHEN r.hs IS NULL THEN 0 ELSE f.grp END, CASE WHEN r.hs IS NULL THEN 0 ELSE f.lvl + 1 END, CASE WHEN r.hs IS NULL THEN f.grp - 1 ELSE f.pos // 16 END,
         CASE WHEN r.hs IS NULL THEN f.h ELSE sha256(array_to_string(r.hs[:f.pos % 16], '') || f.h || array_to_string(r.hs[f.pos % 16 + 2:], '')) END,
         CASE WHEN r.hs IS NULL THEN f.proof ELSE f.proof || array_to_string(r.hs[:f.pos % 16], '') || array_to_string(r.hs[f.pos % 16 + 2:], '') END
  FROM folded f LEFT JOIN runs r ON r.grp = f.grp AND r.lvl = f.lvl AND r.parent = f.pos // 16 WHERE r.hs IS NOT NULL OR f.grp > 0),
ends AS (SELECT k, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM folded WHERE grp = 0 GROUP BY k)
SELECT m.doc_id, m.leaf, s.h AS subroot, o.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = o.h AS verified
FROM marked m JOIN ends e USING (k) JOIN subroots s ON s.grp = m.grp CROSS JOIN (SELECT h FROM outer_nodes WHERE n = 1) o
"""


@query("op12_merkle_manifest", SQL_CHECK)
def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(table(spark, sf, "documents"))
