"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# What the library relies on: AQE turns measured-small sides into broadcasts, splits skewed join
# and rebalance partitions, and merges small ones. These are Spark defaults; they are stated here so
# that a session built by this package has them whatever the site defaults say. The method limit is
# the value Spark's documentation gives for HotSpot, which does not compile longer methods: wide
# projections then run as separate, compiled pieces.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# The temporary folder of each local application that names none.
_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app_name: str = "haulmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; keyword arguments use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made in local mode only: on a cluster the executors
    would write to their own disks what the driver cannot read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master or 'the cluster'} share")
        folder = _LOCAL_FOLDERS.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="haulmark-")
        _LOCAL_FOLDERS[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def pinned(df: DataFrame, label: str, path: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write rows to the shared folder and read them back.

    Cuts the lineage of a loop as a checkpoint does, survives a lost executor, and unlike a checkpoint
    tells the planner how large the rows are, so that only measured-small sides are broadcast.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
