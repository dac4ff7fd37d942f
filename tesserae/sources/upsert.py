"""JSON upserts: a batch of JSON rows becomes a latest-wins frame of a declared table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import FieldDef, Kind, TableDef

_BAD = "_bad"


def parsed(rows: DataFrame, table: TableDef, body: str = "json", seq: str = "seq") -> DataFrame:
    """(seq, id, fields, reason): each JSON text by the table's schema; reason tells why a row is refused, as a whole.

    Members that are not declared are not read. A number outside its declared
    bounds refuses the row. An id may be a text or a whole number.
    """
    schema = T.StructType([*table.json_schema.fields, T.StructField(_BAD, T.StringType())])
    got = rows.select(F.col(seq).cast("long").alias("seq"), F.from_json(body, schema, {"columnNameOfCorruptRecord": _BAD}).alias("v"), F.col(body).alias("_raw"))
    id_ = F.col(f"v.{table.id_field}")
    reason = F.when(F.col("v").isNull() | F.col(f"v.{_BAD}").isNotNull(), "unreadable or of another type").when(id_.isNull(), "no id")
    reason = reason.when(F.get_json_object("_raw", f"$.{table.id_field}").rlike(r"^-?\d*\.\d|^(true|false)$"), "an id is a text or a whole number")
    for f in table.fields:
        c = F.col(f"v.{f.name}")
        if f.kind in (Kind.INT, Kind.FLOAT) and (f.low is not None or f.high is not None):
            outside = (c < F.lit(f.low) if f.low is not None else F.lit(False)) | (c > F.lit(f.high) if f.high is not None else F.lit(False))
            reason = reason.when(outside, f"{f.name} out of bounds")
    return got.select("seq", id_.alias("id"), *[F.col(f"v.{f.name}").alias(f.name) for f in table.fields], reason.alias("reason"))


def _latest(f: FieldDef) -> Column:
    """The field's newest value: the last one present; a bool that the newest row lacks is false."""
    c = F.col(f.name)
    if f.kind is Kind.BOOL:
        return F.coalesce(F.max_by(c, "seq"), F.lit(False))
    c = F.array_distinct(c) if f.kind is Kind.SET else c
    return F.max_by(c, F.when(F.col(f.name).isNotNull(), F.col("seq")))


def merged(current: DataFrame | None, batch: DataFrame, table: TableDef) -> DataFrame:
    """(id, ord, fields, seq) after an upsert: one row per id, ord from its first row. One shuffle on id, with partial aggregation before it."""
    rows = batch.filter("reason is null").drop("reason").withColumn("ord", F.col("seq"))
    if current is not None:
        rows = current.unionByName(rows)
    fields = [f.name for f in table.fields]
    return rows.groupBy("id").agg(F.min("ord").alias("ord"), *[_latest(f).alias(f.name) for f in table.fields], F.max("seq").alias("seq")).select("id", "ord", *fields, "seq")


def latest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order: whole-row replacement."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")
