"""Replicated operation logs: append with checks, replay in order, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = 100_000


def append(log: DataFrame, path: str, index: str = "index") -> None:
    """Appends entries with their checksum, in folders of SEGMENT indices."""
    others = [c for c in log.columns]
    sealed = log.withColumn("crc", F.crc32(F.to_json(F.struct(*others)).cast("binary"))).withColumn("segment", F.floor(F.col(index) / SEGMENT).cast("long"))
    sealed.write.mode("append").partitionBy("segment").parquet(path)


def broken(log: DataFrame, index: str = "index") -> DataFrame:
    """Entries whose checksum does not fit (logs written by `append`)."""
    others = [c for c in log.columns if c not in ("crc", "segment")]
    return log.filter(F.crc32(F.to_json(F.struct(*others)).cast("binary")) != F.col("crc"))


def gaps(log: DataFrame, index: str = "index") -> DataFrame:
    """(first, last, n) if indices are not contiguous, else no row."""
    r = log.agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count_distinct(index).alias("n"))
    return r.filter("last - first + 1 <> n")


def replay(log: DataFrame, machine: str, index: str, op: str, value: str, start: Column | float = 0.0, after: int | None = None) -> DataFrame:
    """(machine, state): each machine's entries after the snapshot index folded in order over + - * /.

    An entry maps a state x to a * x + b, and so does a run of entries: those of
    SEGMENT indices are folded to one (a, b), and a machine's segments are
    composed, so no task holds more than a segment of a hot machine. Other
    operators leave the state. Division by zero leaves null from there on.
    """
    rows = log if after is None else log.filter(F.col(index) > after)
    entry = F.struct(F.col(index).alias("i"), F.col(op).alias("op"), F.col(value).cast("double").alias("v"))
    parts = rows.groupBy(machine, F.floor(F.col(index) / SEGMENT).alias("_segment")).agg(F.array_sort(F.collect_list(entry)).alias("_steps"))
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")).cast("struct<a:double,b:double>")  # of nullable fields

    def step(acc: Column, s: Column) -> Column:
        by = F.when(s["op"] == "*", s["v"]).when(s["op"] == "/", 1 / F.nullif(s["v"], F.lit(0.0))).otherwise(F.lit(1.0))
        # divided, not multiplied by the reciprocal, so that whole quotients stay whole
        scaled = lambda x: F.when(s["op"] == "/", x / F.nullif(s["v"], F.lit(0.0))).otherwise(x * by)
        plus = F.when(s["op"] == "+", s["v"]).when(s["op"] == "-", -s["v"]).otherwise(F.lit(0.0))
        return F.struct(scaled(acc["a"]).alias("a"), (scaled(acc["b"]) + plus).alias("b"))

    folded = parts.select(machine, "_segment", F.aggregate("_steps", one, step).alias("_map"))
    begin = start if isinstance(start, Column) else F.lit(float(start))
    maps = F.array_sort(F.collect_list(F.struct(F.col("_segment").alias("i"), F.col("_map.a").alias("a"), F.col("_map.b").alias("b"))))
    return folded.groupBy(machine).agg(F.aggregate(maps, begin, lambda x, m: x * m["a"] + m["b"]).alias("state"))


def snapshot(state: DataFrame, index: int, path: str) -> None:
    """Writes a state (machine, state) as of an index; a snapshot is complete when its folder is named by the index."""
    state.write.mode("overwrite").parquet(f"{path}/index={index}")


def resumed(spark: SparkSession, path: str, log: DataFrame, machine: str, index: str, op: str, value: str) -> DataFrame:
    """(machine, state): the newest snapshot, with the log's later entries applied to it; machines new to the log start at 0."""
    kept = spark.read.parquet(path)
    last = kept.agg(F.max("index")).first()[0]
    base = kept.filter(F.col("index") == last).select(machine, F.col("state").alias("_state"))
    # a state is a machine's first entry: it is set by + onto 0
    first = base.select(machine, F.lit(last).cast("long").alias(index), F.lit("+").alias(op), F.col("_state").alias(value))
    later = log.filter(F.col(index) > last).select(machine, F.col(index).cast("long").alias(index), op, F.col(value).cast("double").alias(value))
    return replay(first.unionByName(later), machine, index, op, value)


def replay_sum(log: DataFrame, machine: str, op: str, value: str) -> DataFrame:
    """(machine, state) for logs of + and - only, where order does not matter: partial sums before the shuffle."""
    signed = F.when(F.col(op) == "-", -F.col(value)).otherwise(F.col(value))
    return log.groupBy(machine).agg(F.sum(signed).alias("state"))
