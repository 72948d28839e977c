"""Files by path, format and codec."""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Input and output format names and codec names.
READ_FORMATS = ("text", "csv", "json", "orc", "parquet", "avro", "sequence")
CODECS = ("gzip", "bzip2", "default")

_CHUNK = 1 << 20


def _paths(path: str | Sequence[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def expand_globs(spark: SparkSession, path: str | Sequence[str], recursive: bool = False,
                 name_glob: str | None = None) -> DataFrame:
    """Files a path or glob stands for: ``path``, ``bytes``, ``modified``. Contents are not read.

    Names starting with ``_`` or ``.`` are left out. ``recursive`` walks below the given folders,
    which is how a ``**`` pattern is written here (``expand_globs(base, True, "*.csv")``).
    """
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.load(_paths(path)).select(
        "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def path_stats(spark: SparkSession, path: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """One row: how many files a path stands for and their total size."""
    return expand_globs(spark, path, recursive).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def merge_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Many text files read as one input; a last line without a line break stays its own line."""
    return spark.read.text(list(paths))


def _decoder(codec: str):
    if codec == "gzip":
        return lambda: zlib.decompressobj(wbits=31)
    if codec == "bzip2":
        return bz2.BZ2Decompressor
    return lambda: zlib.decompressobj()


def _inflate(data: bytes, codec: str) -> Iterator[bytes]:
    """Decompressed blocks of bounded size; concatenated members are followed."""
    make = _decoder(codec)
    while data:
        engine = make()
        for start in range(0, len(data), _CHUNK):
            yield engine.decompress(data[start:start + _CHUNK])
            if engine.eof:
                data = engine.unused_data + data[start + _CHUNK:]
                break
        else:
            if not engine.eof:
                raise ValueError("compressed file ends early")
            return


def scan_compressed(spark: SparkSession, path: str | Sequence[str], codec: str | None = None) -> DataFrame:
    """Text lines ``value`` and ``_source``. Without ``codec`` the file extension decides.

    An explicit codec beats the extension. Spark picks codecs by extension only, so that one case
    decompresses inside the task, one file per task (these files cannot be split by any reader),
    block by block so that only the compressed file is held.
    """
    if codec is None:
        return spark.read.text(_paths(path)).select("value", F.col("_metadata.file_path").alias("_source"))
    if codec not in CODECS:
        raise ValueError(f"codec {codec!r} is not one of {', '.join(CODECS)}")
    files = spark.read.format("binaryFile").load(_paths(path)).select("path", "content")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rest = b""
                for block in _inflate(content.as_py(), codec):
                    *whole, rest = (rest + block).split(b"\n")
                    if whole:
                        yield _line_batch(whole, name)
                if rest:
                    yield _line_batch([rest], name)

    return files.mapInArrow(lines, "value string, _source string")


def _line_batch(raw: list[bytes], name: str) -> pa.RecordBatch:
    text = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in raw]
    return pa.RecordBatch.from_pydict({"value": pa.array(text, pa.string()),
                                       "_source": pa.array([name] * len(text), pa.string())})


def scan_sequencefile(spark: SparkSession, path: str) -> DataFrame:
    """Key and value of a sequence file as text; the only source that needs the RDD reader."""
    pairs = spark.sparkContext.sequenceFile(path).map(lambda kv: (str(kv[0]), str(kv[1])))
    return spark.createDataFrame(pairs, "key string, value string")


def scan_format(spark: SparkSession, path: str | Sequence[str], fmt: str, **options: str) -> DataFrame:
    """Read a path in a named format."""
    if fmt not in READ_FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {', '.join(READ_FORMATS)}")
    if fmt == "sequence":
        return scan_sequencefile(spark, path)
    try:
        return spark.read.format(fmt).options(**options).load(_paths(path))
    except Exception as error:
        if fmt == "avro":
            raise RuntimeError("avro needs the spark-avro package on the classpath") from error
        raise
