"""Small helpers on DataFrames: intermediate tables, salts and document columns."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; without one there is nowhere that all executors could read."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.startswith("local"):
        # one machine only: the warehouse is as shared as any folder
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tesserae-intermediate"
        spark.sparkContext.setCheckpointDir(folder)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def bounded_batches(spark: SparkSession) -> None:
    """Lets Python see BATCH_ROWS rows at a time, unless the session says how many: Spark's own number, 10,000, is of rows whatever
    their length, and a task holds several such batches of texts beside its heap."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def partition_keys(n: int) -> np.ndarray:
    """An int for each of n partitions that Spark's hash partitioning by an int column deals to it, so that n groups are one to a partition."""
    out, left, start = np.full(n, -1, np.int64), n, 0
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    while left:
        key = np.arange(start, start + 2 * n + 64, dtype=np.uint32)
        start += len(key)
        # Spark's hash: Murmur3 of 32 bits with seed 42
        h = turn(np.uint32(42) ^ (turn(key * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        at = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n
        where, first = np.unique(at, return_index=True)
        new = out[where] < 0
        out[where[new]] = key[first[new]]
        left -= int(new.sum())
    return out


def table(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it again.

    The lineage ends there, so a lost executor costs no recomputation of what
    came before, and later readers get pruned columns. Removed when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)
