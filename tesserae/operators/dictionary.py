"""Write-once dictionaries: put, get, exists, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(puts: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """(key, value) with the last put of each key."""
    return puts.groupBy(key).agg(F.max_by(value, seq).alias(value))


def get(probes: DataFrame, dictionary: DataFrame, key: str, misses: bool = False) -> DataFrame:
    """Probes with their values; those without one only if misses are wanted. Catalyst broadcasts a side that its size allows."""
    return probes.join(dictionary, key, "left" if misses else "inner")


def exists(probes: DataFrame, dictionary: DataFrame, key: str, absent: bool = False) -> DataFrame:
    """The probes that the dictionary has (or has not)."""
    return probes.join(dictionary.select(key), key, "left_anti" if absent else "left_semi")


def merge(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """Both dictionaries; where both have a key, the other's value stays."""
    both = base.select(key, value, F.lit(0).alias("_side")).union(other.select(key, value, F.lit(1).alias("_side")))
    return both.groupBy(key).agg(F.max_by(value, "_side").alias(value))


def commit(dictionary: DataFrame, path: str) -> DataFrame:
    """Writes the dictionary once; an existing one is not overwritten."""
    dictionary.write.mode("error").parquet(path)
    return dictionary.sparkSession.read.parquet(path)


def size(dictionary: DataFrame) -> DataFrame:
    """(n): the number of keys."""
    return dictionary.agg(F.count("*").alias("n"))
