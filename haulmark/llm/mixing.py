"""Mixing sources to target weights by capped water-filling.

Sources get shares of a total by weight. A source can give at most ``max_epochs`` times its size; what it cannot take
is shared again among the others by weight, until none is above its limit. Rounds of clamping end where a level is
reached: with sources in order of limit per unit of weight, those whose limit lies under the level of the rest are clamped,
which running sums over the table of sources find at once.

A document is then repeated ``floor(target / size)`` times, and once more if its seeded hash is low enough: the cut is
the hash up to which the source's words fill the rest of its target, to the nearest document. The cut is found in two
steps, by 4096 hash buckets a source and then inside the one bucket where it falls, so no task sees a whole source.
Reruns, and other partitionings, take the same documents. Copies of a row share a hash and are taken alike.

Null texts have size 0; a null source is a source of its own, last in order; sources of size 0 get target 0; an empty
table gives an empty result. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import pinned
from .common import WORD
from .registry import query, table

MAX_EPOCHS = 3
CYCLE = 3
SEED = 17
BUCKET_DIGITS = 3  # hexadecimal: 4096 buckets a source
BROADCAST_SOURCES = 10_000  # up to so many rows of five columns the plan is broadcast, beyond it is joined


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> Column:
    """A seeded hash of the id and the text that sorts like a uniform number: only true copies of a row are drawn alike."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (doc_id, text)]
    return F.md5(F.concat(F.lit(f"{seed}:"), parts[0], F.lit(":"), parts[1]).cast("binary"))


def water_fill(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size, weight), one row a source, with ``target`` added."""
    everything = W.partitionBy()
    by_limit = W.orderBy("_limit", F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    ranked = sizes.withColumns({
        "_cap": F.lit(max_epochs) * F.col("source_size"),
        "_total": F.sum("source_size").over(everything), "_weights": F.sum("weight").over(everything),
    }).withColumn("_limit", F.col("_cap") * F.lit(1.0) / F.col("weight"))
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) * F.lit(1.0) / (
        F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("_full", F.col("_limit") <= level)
    full = lambda c: F.sum(F.when(F.col("_full"), F.col(c)).otherwise(0)).over(everything)
    share = F.col("weight") * (F.col("_total") - F.col("_used")) * F.lit(1.0) / (F.col("_weights") - F.col("_given"))
    return ranked.withColumns({"_used": full("_cap"), "_given": full("weight")}).select(
        "source", "source_size", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def cyclic_weights(sizes: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """Weights 1, 2, .., cycle, repeating, over the sources by code point, null last."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    return sizes.withColumn("weight", ((rank - 1) % cycle + 1).cast("long"))


def mix_plan(sized: DataFrame, max_epochs: int = MAX_EPOCHS, weights=cyclic_weights) -> DataFrame:
    """(source, source_size, target, whole, cut) from rows (source, size, draw); read more than once."""
    bucketed = sized.withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS))
    buckets = pinned(bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-buckets")
    sizes = weights(buckets.groupBy("source").agg(F.sum("size").alias("source_size")))
    filled = water_fill(sizes, max_epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = pinned(filled.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")

    order = W.partitionBy("source").orderBy("bucket")
    b, t = buckets.alias("b"), targets.alias("t")
    edge = b.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b.bucket", "b.size", "t.rest").withColumn(
        "upto", F.sum("size").over(order)).where("rest > 0 and upto > rest and upto - size <= rest").select(
        "source", "bucket", (F.col("upto") - F.col("size")).alias("before"), "rest")
    e, d = edge.alias("e"), bucketed.alias("d")
    near = d.join(e, F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.bucket") == F.col("e.bucket"))).groupBy(
        "e.source", "e.bucket", "e.before", "e.rest", "d.draw").agg(F.sum("d.size").alias("size"))
    upto = F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("draw"))
    cuts = near.withColumn("upto", upto).groupBy("source", "bucket").agg(
        F.max(F.when(F.col("upto") - F.col("size") / 2 <= F.col("rest"), F.col("draw"))).alias("last")).select(
        "source", F.coalesce("last", "bucket").alias("cut"))  # the bare bucket sorts before all its hashes
    c = cuts.alias("c")
    return t.join(c, F.col("t.source").eqNullSafe(F.col("c.source")), "left").select(
        "t.source", "t.source_size", "t.target", "t.whole", "c.cut")


def with_plan(rows: DataFrame, plan: DataFrame, source: str, draw_column: str) -> DataFrame:
    """Rows with their source's ``source_size`` and ``target`` and their own ``copies``."""
    plan = pinned(plan, "mix-plan")
    small = plan.count() <= BROADCAST_SOURCES
    p, r = (F.broadcast(plan) if small else plan).alias("_plan"), rows.alias("_rows")
    joined = r.join(p, F.col(f"_rows.{source}").eqNullSafe(F.col("_plan.source")), "left")
    extra = F.coalesce((F.col(f"_rows.{draw_column}") <= F.col("_plan.cut")).cast("long"), F.lit(0))
    return joined.select("_rows.*", F.col("_plan.source_size").alias("source_size"),
                         F.col("_plan.target").alias("target"), (F.col("_plan.whole") + extra).alias("copies"))


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights=cyclic_weights) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    sized = pinned(docs.select("doc_id", "source", word_count().alias("size"), draw(seed=seed).alias("draw")), "mix-sizes")
    out = with_plan(sized, mix_plan(sized, max_epochs, weights), "source", "draw")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mixed_documents(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights=cyclic_weights) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    sized = pinned(docs.select("source", word_count().alias("size"), draw(seed=seed).alias("draw")), "mix-sizes")
    plan = mix_plan(sized, max_epochs, weights)
    rows = docs.select(F.struct("*").alias("doc"), F.col("source").alias("mix_source"), draw(seed=seed).alias("mix_draw"))
    out = with_plan(rows, plan, "mix_source", "mix_draw").where("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).select("doc.*")


_SIZED = r"""
sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
  md5('17:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as draw from documents),
sizes as (select source, cast(sum(size) as bigint) as source_size,
  (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from sized group by source),
caps as (select *, 3 * source_size as cap, (3 * source_size) * 1.0::double / weight as lim,
  sum(source_size) over () as total, sum(weight) over () as weights from sizes),
filled as (select *, lim <= (total - coalesce(sum(cap) over before, 0)) * 1.0::double
    / (weights - coalesce(sum(weight) over before, 0)) as is_full
  from caps window before as (order by lim, source nulls last rows between unbounded preceding and 1 preceding)),
used as (select *, sum(case when is_full then cap else 0 end) over () as used,
  sum(case when is_full then weight else 0 end) over () as given from filled),
targets as (select source, source_size, case when is_full then cap::double
    else cast(weight * (total - used) as bigint) * 1.0::double / (weights - given) end as target from used),
plans as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from targets),
rests as (select *, target - whole * source_size as rest from plans),
draws as (select source, draw, sum(size) as size, sum(sum(size)) over (partition by source order by draw) as upto
  from sized group by source, draw)
"""

MIX_SQL = f"""with {_SIZED},
taken as (select s.doc_id, cast(s.size as bigint) as size, p.source_size, p.target, s.source,
  p.whole + case when p.rest > 0 and d.upto - d.size / 2.0::double <= p.rest then 1 else 0 end as copies
  from sized s join rests p on s.source is not distinct from p.source
  join draws d on s.source is not distinct from d.source and s.draw = d.draw)
select doc_id, size, source_size, target, copies * size as taken, source, copies from taken
"""


@query("op3_mix_sources", MIX_SQL)
def op3_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"))
