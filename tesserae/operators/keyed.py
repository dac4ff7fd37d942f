"""Keyed stores: strings, ordered maps and hash maps with expiry, as frames of the latest writes.

A store is a log of writes (pool, key, field, value, seq, expire_at); its state
is the last write of each (pool, key, field) that has not expired and was not deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import EngineError

FIELD_STEP, FIELD_MOST = 8, 256


def check_field_size(size: int) -> int:
    """Fields are of 8, 16, ... 256 bytes."""
    if size <= 0 or size % FIELD_STEP or size > FIELD_MOST:
        raise EngineError(f"a field of {size} bytes")
    return size


def state(writes: DataFrame, keys: list[str], seq: str = "seq", deleted: str | None = None) -> DataFrame:
    """The last write of each key; writes marked deleted remove theirs. One shuffle with partial aggregation."""
    others = [c for c in writes.columns if c not in keys]
    last = writes.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("_w")).select(*keys, *[F.col(f"_w.{c}").alias(c) for c in others])
    return last if deleted is None else last.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def expiry(at: Column, ttl_seconds: Column | int) -> Column:
    """When a write made at a time expires; null for a lifetime of 0 or less."""
    ttl = F.lit(ttl_seconds).cast("long") if isinstance(ttl_seconds, int) else ttl_seconds.cast("long")
    return F.when(ttl > 0, F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + ttl * 1_000_000))


def expire_at(entries: DataFrame, which: Column, at: Column | None, expire_at: str = "expire_at") -> DataFrame:
    """The entries, where those that `which` names expire at the given time; None: never."""
    return entries.withColumn(expire_at, F.when(which, F.lit(None).cast("timestamp") if at is None else at.cast("timestamp")).otherwise(F.col(expire_at)))


def alive(entries: DataFrame, now: Column, expire_at: str = "expire_at") -> DataFrame:
    """Entries without an expiry or with one after now."""
    return entries.filter(F.col(expire_at).isNull() | (F.col(expire_at) > now))


def rearmed(writes: DataFrame, keys: list[str], expire_at: str = "expire_at") -> DataFrame:
    """Each key with the latest expiry of its writes: a map's write with a lifetime re-arms the whole key."""
    return writes.groupBy(*keys).agg(F.max(expire_at).alias(expire_at))


def key_range(entries: DataFrame, key: Column, field: str, low: object, high: object) -> DataFrame:
    """The entries of a key with fields from low to high, both included, in order."""
    return entries.filter(key & F.col(field).between(F.lit(low), F.lit(high))).orderBy(field)


def first_field(entries: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """(key, field, value) of each key's least field."""
    return entries.groupBy(key).agg(F.min(field).alias(field), F.min_by(value, field).alias(value))


def popped(entries: DataFrame, key: str, field: str) -> DataFrame:
    """All entries but each key's least field: minima by partial aggregation, joined back (broadcast if Catalyst finds them small)."""
    least = entries.groupBy(F.col(key).alias("_key")).agg(F.min(field).alias("_least"))
    return entries.join(least, F.col(key).eqNullSafe(F.col("_key"))).filter(F.col(field) != F.col("_least")).drop("_key", "_least")


def sizes(entries: DataFrame, key: str) -> DataFrame:
    """(key, n): entries of each key."""
    return entries.groupBy(key).agg(F.count("*").alias("n"))


def unsigned_order(field: Column) -> Column:
    """The big-endian bytes of a long: their order is that of the unsigned number, negatives after positives."""
    return F.unhex(F.lpad(F.hex(field), 16, "0"))


def ordered(entries: DataFrame, key: str, field: str) -> DataFrame:
    """The entries by key, then by the unsigned order of their fields: sorted by ranges, so a hot key is spread."""
    return entries.orderBy(key, unsigned_order(F.col(field)))


def pools(entries: DataFrame, pool: str) -> DataFrame:
    """(pool, n): the pools of a store and how many entries each holds."""
    return entries.groupBy(pool).agg(F.count("*").alias("n"))


def save(entries: DataFrame, path: str, now: Column, pool: str | None = None, expire_at: str = "expire_at") -> None:
    """Writes what is alive at `now`, one folder to a pool; expiries are points in time, so they hold however much later it is read."""
    writer = alive(entries, now, expire_at).write.mode("overwrite")
    (writer.partitionBy(pool) if pool else writer).parquet(path)


def load(spark: SparkSession, path: str, schema: T.StructType, now: Column, expire_at: str = "expire_at") -> DataFrame:
    """The saved entries that are alive at `now`; what expired in between does not come back."""
    return alive(spark.read.schema(schema).parquet(path), now, expire_at).select(*schema.names)
