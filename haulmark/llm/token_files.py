"""Token-id files with a minimal perfect hash index.

A folder holds three Parquet tables, written by Spark, so that any store works that Spark can reach:

* ``payload``: rows of raw little-endian ids (two bytes an id where the vocabulary allows, else four), whole documents one
  after another in ascending key order (null keys last). A row is a shard of about ``SHARD_IDS`` ids with its number, its global start, and its
  documents' keys and lengths.
* ``index``: one row for each partition of the key hash, about ``PARTITION_KEYS`` keys each: the pilots of a minimal perfect hash
  and its slots, packed. A slot holds a 32-bit fingerprint of the key, the shard, the place in it, the number of ids, and the global start.
* ``meta``: one row: the number of partitions, documents, ids, and bytes an id.

A lookup hashes the key to its partition, reads one pilot and one slot, and compares the stored fingerprint: constant time,
whatever the number of keys. The perfect hash is built per partition by trying pilots for small groups of keys, largest
first, until each key has a slot of its own. Keys that are not in the index are told by the fingerprint (2**-32 of them pass).

Repeated keys are stored each, next to each other; the index leads to the first, and the slot's count tells how many.
Null and empty texts store the end id alone. An empty table gives empty tables.
"""

from __future__ import annotations

import struct
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import pinned, scratch_path
from .bpe import Encoder, tokenizer_path
from .common import map_rows, raw_text
from .registry import query, table

END_ID = 0
SHARD_IDS = 500_000
PARTITION_KEYS = 4_000
GROUP_KEYS = 4  # keys that share a pilot, on average
LITTLE = sys.byteorder == "little" and array("H").itemsize == 2 and array("I").itemsize == 4
NULL_KEY = b"\x00null"

SLOT = np.dtype([("print", "<u4"), ("copies", "<u4"), ("n", "<i8"), ("shard", "<i8"), ("at", "<i8"), ("start", "<i8")])


def packed16(ids: list[int]) -> bytes:
    return array("H", ids).tobytes() if LITTLE else struct.pack(f"<{len(ids)}H", *ids)


def packed32(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if LITTLE else struct.pack(f"<{len(ids)}I", *ids)


def key_hashes(keys: list) -> np.ndarray:
    """Three hashes a key: partition, slot and fingerprint."""
    raw = [NULL_KEY if k is None else struct.pack("<q", k) for k in keys]
    return np.array([[xxhash.xxh64_intdigest(r, s) for s in (1, 2, 3)] for r in raw], np.uint64).reshape(-1, 3)


def _place(h: np.ndarray, pilot: np.ndarray | int, n: int) -> np.ndarray:
    x = (h ^ (np.uint64(0x9E3779B97F4A7C15) * (np.asarray(pilot, np.uint64) + np.uint64(1))))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


def perfect_pilots(h: np.ndarray) -> np.ndarray:
    """Pilots that give ``n`` distinct hashes ``n`` distinct places below ``n``."""
    n = len(h)
    groups = max(1, -(-n // GROUP_KEYS))
    group = (h % np.uint64(groups)).astype(np.int64)
    pilots, free = np.zeros(groups, np.uint32), np.ones(n, bool)
    order = np.argsort(group, kind="stable")
    members = np.split(order, np.cumsum(np.bincount(group, minlength=groups))[:-1])
    for g in sorted(range(groups), key=lambda i: -len(members[i])):
        mine = h[members[g]]
        if not len(mine):
            continue
        base = 0
        while True:  # many pilots at a time; the last groups have few free places left
            tries = np.arange(base, base + 256, dtype=np.uint64)
            places = _place(mine[None, :], tries[:, None], n)
            good = free[places].all(axis=1)
            if len(mine) > 1:
                s = np.sort(places, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            found = np.flatnonzero(good)
            if len(found):
                pilots[g] = tries[found[0]]
                free[places[found[0]]] = False
                break
            base += 256
    return pilots


def lookup(keys: list, pilots: bytes, slots: bytes) -> list[tuple | None]:
    """(n, shard, at, start, copies) of each key of one partition, None where the fingerprint differs."""
    table_, pilot = np.frombuffer(slots, SLOT), np.frombuffer(pilots, "<u4")
    if not len(table_):
        return [None] * len(keys)
    h = key_hashes(keys)
    found = table_[_place(h[:, 1], pilot[(h[:, 1] % np.uint64(len(pilot))).astype(np.int64)], len(table_))]
    same = found["print"] == (h[:, 2] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [(int(f["n"]), int(f["shard"]), int(f["at"]), int(f["start"]), int(f["copies"])) if ok else None for f, ok in zip(found, same)]


def _shards(docs: DataFrame, tokenizer: str, key: str, text: str, shard_ids: int) -> DataFrame:
    """Sorted documents as shard rows: part, row in part, payload, keys, lengths."""
    fields = pa.schema([("part", pa.int32()), ("row", pa.int32()), ("payload", pa.binary()),
                        ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("width", pa.int32()), ("ids", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part, path = TaskContext.get().partitionId(), tokenizer_path(tokenizer)
        wide = Encoder.of(path, len).lib.get_vocab_size() > 1 << 16
        encoder, size = Encoder.of(path, packed32 if wide else packed16), 4 if wide else 2
        end = encoder.value([END_ID])
        body, keys, lengths, total, row = [], [], [], 0, 0

        def shard():
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
                (part, row, b"".join(body), keys, lengths, size, total), fields)], schema=fields)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for k, t in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    ids = b"".join([*encoder.values((t or b"").decode("utf-8", "replace")), end])
                    n = len(ids) // size
                    if total and total + n > shard_ids:
                        yield shard()
                        row, body, keys, lengths, total = row + 1, [], [], [], 0
                    body.append(ids)
                    keys.append(k)
                    lengths.append(n)
                    total += n
        if keys:
            yield shard()

    # Equal keys may go to different ranges only as whole runs of the sort, so order by the text's hash too: reruns agree.
    ordered = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("mark"), raw_text(text).alias("text"))
    by = [F.col("key").asc_nulls_last(), F.col("mark").asc()]
    placed = ordered.repartitionByRange(*by).sortWithinPartitions(*by).select("key", "text")
    return placed.mapInArrow(run, "part int, row int, payload binary, keys array<bigint>, lengths array<bigint>, width int, ids long")


def _build(pdf_keys: np.ndarray, columns: dict[str, np.ndarray]) -> tuple[bytes, bytes]:
    h = key_hashes([None if x is None else int(x) for x in pdf_keys])
    pilots = perfect_pilots(h[:, 1])
    place = _place(h[:, 1], pilots[(h[:, 1] % np.uint64(len(pilots))).astype(np.int64)], len(h))
    slots = np.zeros(len(h), SLOT)
    slots["print"][place] = (h[:, 2] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for name in ("copies", "n", "shard", "at", "start"):
        slots[name][place] = columns[name]
    return pilots.astype("<u4").tobytes(), slots.tobytes()


def _partition(partitions: int):
    """The partition of each key, by the first hash."""
    def fn(batches):
        for batch in batches:
            keys = batch.column(0)
            part = (key_hashes(keys.to_pylist())[:, 0] % np.uint64(partitions)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], ["index_part", *batch.schema.names])

    return fn


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text",
                      shard_ids: int = SHARD_IDS, partition_keys: int = PARTITION_KEYS) -> None:
    """Write the payload and index of ``docs`` under ``folder``, which must not hold them yet."""
    spark = docs.sparkSession
    _shards(docs, tokenizer, key, text, shard_ids).write.option("compression", "zstd").parquet(f"{folder}/raw")
    raw = spark.read.parquet(f"{folder}/raw")
    # Shard numbers and global starts: sums over one row a part, then over a part's few rows.
    parts = raw.groupBy("part").agg(F.sum("ids").alias("ids"), F.count(F.lit(1)).alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"),
                         F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    starts = raw.select("part", "row", "ids").join(bases, "part").select(
        "part", "row", (F.col("first") + F.col("row")).alias("shard"),
        (F.col("base") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).alias("start"))
    starts.write.parquet(f"{folder}/shards")
    shards = spark.read.parquet(f"{folder}/shards")

    def documents(batches):
        for batch in batches:
            for keys, lengths, shard, start in zip(*(c.to_pylist() for c in batch.columns)):
                n = np.array(lengths, np.int64)
                at = np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n), pa.array(np.full(len(n), shard, np.int64)),
                                                  pa.array(at), pa.array(at + start)], ["key", "n", "shard", "at", "start"])

    listed = raw.select("part", "row", "keys", "lengths").join(shards, ["part", "row"]).select("keys", "lengths", "shard", "start").mapInArrow(
        documents, "key long, n long, shard long, at long, start long")
    entry = F.struct("start", "n", "shard", "at")
    entries = pinned(listed.groupBy("key").agg(F.min(entry).alias("e"), F.count(F.lit(1)).alias("copies")).select("key", "copies", "e.*"), "token-keys")
    n_keys = entries.count()
    partitions = max(1, -(-n_keys // partition_keys))

    def build(keys, group):
        columns = {c: group.column(c).to_numpy() for c in ("copies", "n", "shard", "at", "start")}
        pilots, slots = _build(group.column("key").to_pylist(), columns)
        return pa.table({"index_part": pa.array([keys[0].as_py()], pa.int64()), "pilots": pa.array([pilots], pa.binary()),
                         "slots": pa.array([slots], pa.binary())})

    keyed = entries.select("key", "copies", "n", "shard", "at", "start").mapInArrow(
        _partition(partitions), "index_part long, key long, copies long, n long, shard long, at long, start long")
    keyed.groupBy("index_part").applyInArrow(build, "index_part long, pilots binary, slots binary").write.parquet(f"{folder}/index")
    meta = raw.agg(F.coalesce(F.sum("ids"), F.lit(0)).alias("ids"), F.coalesce(F.max("width"), F.lit(2)).alias("width"))
    meta.select(F.lit(partitions).cast("long").alias("partitions"), F.lit(n_keys).cast("long").alias("keys"), "ids", "width").write.parquet(f"{folder}/meta")


def find_documents(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, n, shard, at, start, copies) of each distinct key of ``keys`` that the index holds."""
    spark = keys.sparkSession
    meta = spark.read.parquet(f"{folder}/meta").first()
    asked = keys.select(F.col(key).cast("long").alias("key")).distinct().mapInArrow(_partition(meta.partitions), "index_part long, key long")
    index = spark.read.parquet(f"{folder}/index")
    schema = "key long, n long, shard long, at long, start long, copies long"
    names = [x.split()[0] for x in schema.split(", ")]

    def find(asked_, index_):
        wanted = asked_.column("key").to_pylist()
        rows = [(k, *f) for k, f in zip(wanted, lookup(wanted, index_.column("pilots")[0].as_py(), index_.column("slots")[0].as_py()))
                if f] if index_.num_rows else []
        return pa.table({c: pa.array(list(v), pa.int64()) for c, v in zip(names, zip(*rows) if rows else [[]] * len(names))})

    return asked.groupBy("index_part").cogroup(index.groupBy("index_part")).applyInArrow(find, schema)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, at, key, n, ids_crc32) of every stored document, from the payload rows."""
    width = spark.read.parquet(f"{folder}/meta").first().width
    raw = spark.read.parquet(f"{folder}/raw").select("part", "row", "payload", "keys", "lengths")
    shards = spark.read.parquet(f"{folder}/shards").select("part", "row", "shard")

    def setup():
        def fn(part, row, payload, keys, lengths):
            at = 0
            ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4")
            for k, n in zip(keys, lengths):
                yield part, row, at, k, n, zlib.crc32(ids[at:at + n].astype("<u4").tobytes())
                at += n

        return fn

    crcs = map_rows(raw, setup, [("part", "int"), ("row", "int"), ("at", "long"), ("key", "long"), ("n", "long"), ("ids_crc32", "long")])
    return crcs.join(shards, ["part", "row"]).select("shard", "at", "key", "n", "ids_crc32")


def stored_ids(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, ids) of the asked keys: index lookups, then slices of the shards they lead to."""
    spark = keys.sparkSession
    width = spark.read.parquet(f"{folder}/meta").first().width
    found = find_documents(keys, folder, key).select("key", "n", "shard", "at")
    shards = spark.read.parquet(f"{folder}/shards").select("part", "row", "shard")
    raw = spark.read.parquet(f"{folder}/raw").select("part", "row", "payload")
    places = found.join(shards, "shard").groupBy("part", "row").agg(F.collect_list(F.struct("key", "at", "n")).alias("places"))

    def setup():
        def fn(payload, places):
            ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4")
            for p in places:
                yield p["key"], ids[p["at"]:p["at"] + p["n"]].astype(np.int64).tolist()

        return fn

    return map_rows(raw.join(places, ["part", "row"]).select("payload", "places"), setup, [("key", "long"), ("ids", "array<long>")])


def stored_documents(docs: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, start, n_tokens, ids_crc32, found by its key and read back from the files.

    Rows that share a key take its stored copies in order.
    """
    spark = docs.sparkSession
    found = find_documents(docs, folder, key)
    stored = pinned(read_documents(spark, folder), "token-documents")
    first = found.where("copies = 1").join(stored.drop("key", "n"), ["shard", "at"]).select("key", "start", "n", "ids_crc32")
    # Of repeated keys the stored copies follow one another; their places come from the shards' own lists.
    shards = spark.read.parquet(f"{folder}/shards").select("shard", F.col("start").alias("shard_start"))
    many = found.where("copies > 1").select(F.col("key").alias("k"))
    more = stored.alias("s").join(many.alias("m"), F.col("s.key").eqNullSafe(F.col("m.k")), "left_semi").join(shards, "shard").select(
        "key", (F.col("shard_start") + F.col("at")).alias("start"), "n", "ids_crc32")
    return first.unionByName(more).select(F.col("key").alias("doc_id"), "start", F.col("n").alias("n_tokens"), "ids_crc32")


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    docs, folder = table(spark, sf, "documents"), scratch_path(spark, "token-files")
    write_token_files(docs, folder)
    return stored_documents(docs, folder)
