"""Structured Streaming: upserts, JSON lines, logs and expiring keys, each batch applied exactly once.

Every sink keeps one folder per applied batch (`batch=<id>`), which a repeated
batch overwrites; the current state is the last write of each key over them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed import alive, state
from ..operators.oplog import replay
from ..operators.stats import capped
from ..sources.json_lines import parse_lines


def append_batches(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None, available: bool = True) -> StreamingQuery:
    """Writes each micro-batch to its own folder under path."""

    def sink(batch: DataFrame, number: int) -> None:
        (change(batch) if change else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available else writer).start()


def upsert_state(spark: SparkSession, path: str, keys: list[str], seq: str, schema: T.StructType) -> DataFrame:
    """The last write of each key over all applied batches."""
    return state(spark.read.schema(schema).parquet(path).select(*schema.names), keys, seq)


def expiring_state(spark: SparkSession, path: str, keys: list[str], seq: str, schema: T.StructType, now) -> DataFrame:
    """As upsert_state, without entries whose expire_at has passed."""
    return alive(upsert_state(spark, path, keys, seq, schema), now)


def capped_state(spark: SparkSession, path: str, key: str, value: str, seq: str, schema: T.StructType, limit: int) -> DataFrame:
    """What a capped field keeps of the current state: the `limit` largest values, ties to the larger key."""
    return capped(upsert_state(spark, path, [key], seq, schema), value, key, limit)


def log_state(spark: SparkSession, path: str, machine: str, index: str, op: str, value: str, schema: T.StructType, start: float = 0.0, after: int | None = None) -> DataFrame:
    """(machine, state): applied log entries folded in order, each index once, from a snapshot on."""
    once = spark.read.schema(schema).parquet(path).select(*schema.names).dropDuplicates([machine, index])
    return replay(once, machine, index, op, value, start, after)


def compact(spark: SparkSession, path: str, target: str, keys: list[str], seq: str, schema: T.StructType) -> None:
    """Writes the state of all applied batches to a folder of its own, as one batch: readers of it see no superseded writes.
    Applied batches stay, and running it again replaces the folder."""
    upsert_state(spark, path, keys, seq, schema).write.mode("overwrite").parquet(f"{target}/batch=0")


def live_spans(stream: DataFrame, time: str, key: str, ttl: str, late: str) -> DataFrame:
    """(key, born, expires, writes): a key lives from its first write until none has come for `ttl`.

    Session windows keep the state of live keys only: once the watermark has passed
    a key's expiry, its span is given and its state is dropped.
    """
    spans = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.session_window(time, ttl).alias("_w"), key)
    return spans.agg(F.count("*").alias("writes")).select(key, F.col("_w.start").alias("born"), F.col("_w.end").alias("expires"), "writes")


def json_line_stream(spark: SparkSession, folder: str, schema: T.StructType, files_each: int = 100) -> DataFrame:
    """A stream of JSON lines of a folder; unreadable lines are left out."""
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", files_each).text(folder), schema)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """(window, key, n) by event time, with rows later than `late` left out and their state dropped."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
