"""SimHash near-duplicates with pivot distance tables.

Every distinct fingerprint gets a table row of its Hamming distances to ``PIVOTS`` reference fingerprints. By the triangle
inequality two fingerprints whose distances to any pivot differ by more than the radius cannot be near, so a pair is
discarded by its largest coordinate difference, and only survivors are compared bit by bit.

Pairs to look at come from an equality join, never from all pairs: fingerprints that differ in at most four bits agree on at
least two of six bands, so each is listed under its 15 pairs of bands, and a link counts where its first two equal bands
meet. Unrelated fingerprints meet by chance the more the corpus grows, so from ``BY_BANDS`` fingerprints on there are seven bands of
which three agree (27 bits in place of 20), then eight of which four do (32 bits): the links are the same.
In a crowded group of equal bands (many near copies) some members are picked as leaders; a member is linked to the leaders
within the radius, and two members that share a leader are not compared, because they are connected already. All
connections remain, while the links of a dense group stay in proportion to its members. Components come from
contraction (``components``).

Texts without words (null, empty, blank) have fingerprint zero and are linked like any other. Rows are judged by
their text alone; repeated rows share a component. Null ids are never a component's smallest id unless all are null. An
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import map_rows, raw_text
from .components import components
from .registry import query, table
from ..session import pinned

SHINGLE = 4
SEED = 42
RADIUS = 4
PIVOTS = 16
BY_BANDS = ((6, 1 << 27), (7, 1 << 33), (8, None))  # bands, up to so many fingerprints: some 64 chance members a group
CROWDED = 128  # members of a band pair from which leaders are picked
LEADERS = 6


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        spans = list(zip(starts, ends[shingle - 1:]))
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(spans), 32_768):  # 64 bytes a shingle, a bounded number at a time
        h = np.array([digest(joined[a:b - 1] if b <= len(joined) else joined[a:], seed) for a, b in spans[at:at + 32_768]], np.uint64)
        if len(words) <= shingle:
            h = np.array([digest(joined, seed)], np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(spans), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, text: str = "text", keep=("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """``keep`` (of type long) and ``fp``, the fingerprint as a signed long."""
    def setup():
        return lambda *cells: [(*cells[:-1], signed(fingerprint(cells[-1] or b"", shingle)))]

    return map_rows(docs.select(*keep, raw_text(text)), setup, [*((k, "long") for k in keep), ("fp", "long")])


def bands_for(n: int) -> int:
    """How many bands to cut ``n`` fingerprints into."""
    return next(bands for bands, most in BY_BANDS if most is None or n <= most)


def _keys(bands: int, equal: int) -> list[tuple[int, list[int]]]:
    """Of each choice of ``equal`` bands: their bits, and the bits of each other band before the last of them."""
    ends = list(accumulate(64 // bands + (i < 64 % bands) for i in range(bands)))
    masks = [((1 << e) - 1) ^ ((1 << s) - 1) for s, e in zip([0, *ends], ends)]
    return [(sum(masks[i] for i in chosen), [masks[i] for i in range(chosen[-1]) if i not in chosen]) for chosen in combinations(range(bands), equal)]


def _near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def near_links(prints: DataFrame, radius: int = RADIUS, pivots: int = PIVOTS, crowded: int = CROWDED, leaders: int = LEADERS,
               bands: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp``, which are counted, that connect all pairs within ``radius``."""
    bands = bands or bands_for(prints.count())
    if radius > bands - 2:
        raise ValueError(f"two of {bands} equal bands are certain only up to a radius of {bands - 2}")
    references = [F.lit(signed(xxhash.xxh64_intdigest(f"pivot {i}"))) for i in range(pivots)]
    pairs = _keys(bands, bands - max(radius, 4))
    listed = prints.select("fp", *(F.bit_count(F.col("fp").bitwiseXOR(r)).cast("byte").alias(f"p{i}") for i, r in enumerate(references)),
                           F.explode(F.array(*[F.struct(F.lit(k).cast("byte").alias("pair"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits"),
                                                        F.array(*[F.lit(signed(x)).cast("long") for x in before]).cast("array<long>").alias("before"))
                                               for k, (m, before) in enumerate(pairs)])).alias("key")).select("key.*", "fp", *(f"p{i}" for i in range(pivots)))
    on = ["pair", "bits"]
    # xxhash64(fp, i) gives each of the leaders its own order, so that they are spread over the members.
    picks = F.array(*[F.min_by("fp", F.xxhash64("fp", F.lit(i))) for i in range(leaders)])
    crowds = listed.groupBy(*on).agg(F.count(F.lit(1)).alias("members"), picks.alias("leaders")).where(F.col("members") >= crowded)
    crowds = pinned(crowds.select(*on, "leaders"), "simhash-crowds")
    led = listed.join(crowds, on, "left")
    mine = reduce(lambda x, y: x.bitwiseOR(y), [F.when(_near(F.col("fp"), F.col("leaders")[i], radius), F.lit(1 << i)).otherwise(F.lit(0))
                                                for i in range(leaders)])
    led = led.withColumn("led", F.coalesce(mine, F.lit(0)))
    stars = led.where("led <> 0").select(
        F.col("fp").alias("a"), F.explode(F.filter("leaders", lambda x: _near(x, F.col("fp"), radius))).alias("b")).where("a <> b")
    slim = led.drop("leaders")
    # Spark takes rows listed under many keys for as few as the fingerprints, and would broadcast them all.
    x, y = slim.alias("x"), slim.drop("before").alias("y").hint("merge")
    close = [F.abs(F.col(f"x.p{i}").cast("int") - F.col(f"y.p{i}").cast("int")) <= radius for i in range(pivots)]
    apart = F.col("x.led").bitwiseAND(F.col("y.led")) == 0
    first = F.forall("x.before", lambda m: F.col("x.fp").bitwiseXOR(F.col("y.fp")).bitwiseAND(m) != 0)
    condition = (F.col("x.pair") == F.col("y.pair")) & (F.col("x.bits") == F.col("y.bits")) & (F.col("x.fp") < F.col("y.fp"))
    for test in (*close, apart, _near(F.col("x.fp"), F.col("y.fp"), radius), first):
        condition = condition & test
    found = x.join(y, condition).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    return found.unionByName(stars)


def near_duplicates(prints: DataFrame, doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Rows (fp, component_id) for every fingerprint of the table ``prints`` (doc_id, fp), which is read more than once."""
    classes = pinned(prints.groupBy("fp").agg(F.min(doc_id).alias("first")), "simhash-classes")
    roots = pinned(components(near_links(classes.select("fp"), radius)).select(F.col("node").alias("fp"), "root"), "simhash-roots")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, fingerprint, component_id."""
    prints = pinned(fingerprints(docs), "simhash-prints")
    joined = prints.join(near_duplicates(prints, radius=radius), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, with its own columns: the one of the smallest doc_id (null last), and of
    different texts under that id the one of the smallest text hash; of repeated rows one stays."""
    mark = F.xxhash64("text").alias("_mark")
    prints = pinned(fingerprints(docs.select("doc_id", "text", mark), keep=("doc_id", "_mark")), "simhash-prints")
    ids = pinned(prints.join(near_duplicates(prints, radius=radius), "fp").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_mark")).alias("kept")).select("kept.doc_id", "kept._mark"), "simhash-kept")
    again = prints.groupBy("doc_id", "_mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "_mark")
    key = lambda d, side: F.col(f"{d}.doc_id").eqNullSafe(F.col(f"{side}.doc_id")) & (F.col(f"{d}._mark") == F.col(f"{side}._mark"))
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", mark).alias("d").join(ids.alias("k"), key("d", "k"), "left_semi")
    once = rows.alias("d").join(again.alias("r"), key("d", "r"), "left_anti")
    more = rows.alias("d").join(again.alias("r"), key("d", "r"), "left_semi").dropDuplicates(["doc_id", "_mark"])
    return once.select("doc.*").unionByName(more.select("doc.*"))


@query("op4_simhash_pivots")
def op4_simhash_pivots(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_components(table(spark, sf, "documents"))
