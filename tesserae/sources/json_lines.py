"""Datasets of JSON lines: build by key, incremental merge, append, and a registry of builders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..types import EngineError
from .upsert import latest_rows


def parse_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Rows of JSON lines; empty and unreadable lines are left out."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    got = lines.filter(F.trim(column) != "").select(*[c for c in lines.columns if c != column], F.from_json(column, full, {"columnNameOfCorruptRecord": "_bad"}).alias("v"))
    return got.filter("v is not null and v._bad is null").select(*[c for c in got.columns if c != "v"], *[F.col(f"v.{f.name}").alias(f.name) for f in schema.fields])


def one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: of several, the one whose JSON text is the greatest, so that a repeated task gives the same."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(whole, F.to_json(whole)).alias("_row")).select("_row.*")


def build(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """One row per key of a file of JSON lines; of lines of one key the greatest."""
    return one_each(parse_lines(spark.read.text(path), schema), [key])


def merge(base: DataFrame, increments: list[DataFrame], keys: list[str]) -> DataFrame:
    """The base with every increment's rows in place of its own: the last increment that has a key wins. One shuffle."""
    parts = [df.withColumn("_seq", F.lit(i)) for i, df in enumerate([base, *increments])]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return latest_rows(every, keys, ["_seq"]).drop("_seq")


def append(df: DataFrame, path: str, truncate: bool = False) -> None:
    """Writes rows as JSON lines."""
    df.write.mode("overwrite" if truncate else "append").json(path)


@dataclass(frozen=True)
class Builder:
    """A named dataset: how to read its lines, and its keys."""

    schema: T.StructType
    keys: tuple[str, ...]

    def batch(self, spark: SparkSession, path: str) -> DataFrame:
        return one_each(parse_lines(spark.read.text(path), self.schema), list(self.keys))

    def stream(self, spark: SparkSession, folder: str, path: str, checkpoint: str) -> StreamingQuery:
        """Reads a folder's lines as they come and writes the rows of each batch under path, once."""
        lines = parse_lines(spark.readStream.text(folder), self.schema)
        sink = lambda batch, number: one_each(batch, list(self.keys)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        return lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def merged(self, base: DataFrame, increments: list[DataFrame]) -> DataFrame:
        return merge(base, increments, list(self.keys))

    def broken(self, spark: SparkSession, path: str) -> DataFrame:
        """(value): the lines that are no rows of this dataset: unreadable, or without a key."""
        lines = spark.read.text(path).filter(F.trim("value") != "")
        return lines.join(parse_lines(lines.withColumn("line", F.col("value")), self.schema).dropna(subset=list(self.keys)).select(F.col("line").alias("value")).distinct(), "value", "left_anti")

    def lookup(self, data: DataFrame, probes: DataFrame) -> DataFrame:
        """The rows of the probes' keys."""
        return data.join(probes.select(*self.keys).distinct(), list(self.keys), "left_semi")


BUILDERS: dict[str, Builder] = {}


def register(name: str, schema: T.StructType, *keys: str) -> Builder:
    BUILDERS[name] = Builder(schema, keys)
    return BUILDERS[name]


def builder(name: str) -> Builder:
    """The registered dataset of a name."""
    if name not in BUILDERS:
        raise EngineError(f"no dataset {name}")
    return BUILDERS[name]


def encoded(column: Column) -> Column:
    """Bytes as base64 text in one line: Spark breaks it at 76 characters."""
    return F.translate(F.base64(column), "\r\n", "")


def decoded(column: Column) -> Column:
    """Base64 text as bytes; text that is not base64 gives null."""
    return F.try_to_binary(column, F.lit("base64"))
