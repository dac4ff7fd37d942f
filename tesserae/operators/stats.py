"""Statistics of indexed fields: extremes with ties, top-k, inverted index and bit slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extreme(df: DataFrame, value: str, largest: bool, where: Column | None = None) -> DataFrame:
    """(v, n): the largest or least value and how many rows have it, in one pass: counts by value, then the extreme count."""
    df = (df if where is None else df.filter(where)).filter(F.col(value).isNotNull())
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("v") if largest else F.asc("v")).limit(1)


def top(df: DataFrame, value: str, id_: str, k: int, largest: bool = True) -> DataFrame:
    """The k rows of largest (or least) values, ties to the smaller id."""
    return df.filter(F.col(value).isNotNull()).orderBy(F.desc(value) if largest else F.asc(value), id_).limit(k)


def without_least(df: DataFrame, value: str, id_: str) -> DataFrame:
    """All rows but the one of least value, then least id."""
    return df.join(top(df, value, id_, 1, False).select(id_), id_, "left_anti")


def capped(df: DataFrame, value: str, id_: str, limit: int) -> DataFrame:
    """What a capped field keeps: the `limit` largest values, ties to the larger id."""
    return df.filter(F.col(value).isNotNull()).orderBy(F.desc(value), F.desc(id_)).limit(limit)


def capped_by_key(entries: DataFrame, key: str, value: str, id_: str, limit: int, where: Column | None = None) -> DataFrame:
    """For each key the `limit` heaviest entries (of those that `where` allows), ties to the larger id; ranks are limited before the shuffle."""
    entries = entries if where is None else entries.filter(where)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), F.desc(id_)))
    return entries.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def inverted(df: DataFrame, values: str, id_: str) -> DataFrame:
    """(value, bucket, bitmap): which ids have each member of a set field, as bitmaps of 32,768 ids."""
    rows = df.select(F.explode(values).alias("value"), F.col(id_).cast("long").alias("_id"))
    places = rows.select("value", F.bitmap_bucket_number("_id").alias("bucket"), F.bitmap_bit_position("_id").alias("bit"))
    return places.groupBy("value", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def cardinalities(df: DataFrame, values: str, id_: str) -> DataFrame:
    """(value, n): how many ids have each member, from the inverted index."""
    return inverted(df, values, id_).groupBy("value").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def bit_depth(low: int, high: int) -> int:
    """The least number of bits for values from low to high."""
    return max(0, (high - low).bit_length())


def slice_counts(df: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """(b, n): how many values have each bit of value - low, least bit first."""
    bits = bit_depth(low, high)
    sums = [F.sum(F.shiftright(F.col(value) - low, b).bitwiseAND(F.lit(1))).cast("long").alias(f"b{b}") for b in range(bits)]
    stack = ", ".join(f"{b}, b{b}" for b in range(bits))
    return df.agg(*sums).selectExpr(f"stack({bits}, {stack}) as (b, n)")


def order_image(column: Column) -> Column:
    """The unsigned image of a 32-bit float's bits that keeps its order, -0.0 just below 0.0, as long."""
    bits = _float_bits(column.cast("float"))
    return F.when(bits >= 0, bits + (1 << 31)).otherwise(F.lit(-1) - bits)


def _float_bits(column: Column) -> Column:
    """The four bytes of a float as a signed number; arithmetic would see neither the sign of a zero nor that of NaN."""
    return F.when(column.isNotNull(), F.reflect(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), column).cast("long"))
