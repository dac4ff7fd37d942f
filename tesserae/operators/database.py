"""A database of declared tables that share one id space."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.predicate import IdSet, compile_query, ids
from ..sources import upsert
from ..sources.ddl import declare
from ..types import EngineError, FieldDef, Kind, TableDef, TypeMismatch
from .stats import capped, capped_by_key


@dataclass(frozen=True)
class Selection:
    """rows: the page of ids in order; matched: all ids (id, ord)."""

    rows: DataFrame
    matched: DataFrame

    @property
    def total(self) -> int:
        return self.matched.count()

    def total_frame(self) -> DataFrame:
        return self.matched.agg(F.count("*").alias("total"))


def page(matched: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """Ids in order of first sight; a limit of 0 or less means 100, a negative offset 0."""
    return matched.orderBy("ord", "id").offset(max(offset, 0)).limit(limit if limit > 0 else 100).select("id")


def limited(frame: DataFrame, table: TableDef) -> DataFrame:
    """The rows of a table, where fields with a topk_limit keep their largest values, and weight sets the heaviest ids of each key. No row goes."""
    for f in table.fields:
        if f.topk_limit <= 0 or f.kind not in (Kind.INT, Kind.FLOAT, Kind.WEIGHT_SET):
            continue
        c = F.col(f"`{f.name}`")
        own = F.col("id").alias("_id")
        if f.kind is Kind.WEIGHT_SET:
            entries = capped_by_key(frame.select(own, F.explode(c).alias("_key", "_weight")), "_key", "_weight", "_id", f.topk_limit)
            kept = entries.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_key", "_weight"))).alias("_kept"))
            value = F.when(c.isNotNull(), F.coalesce("_kept", F.create_map().cast(f.spark_type)))
        else:
            kept = capped(frame.select(own, c.alias("_kept")), "_kept", "_id", f.topk_limit)
            value = F.col("_kept")
        frame = frame.join(kept, F.col("id") == F.col("_id"), "left").withColumn(f.name, value).drop("_id", "_kept")
    return frame


class Database:
    """Tables by name. Frames have a unique column id, ord (the order of first sight) and the declared fields."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, TableDef] = {}
        self.frames: dict[str, DataFrame] = {}
        self._removed: list[DataFrame] = []  # (id, ord) of removed rows: an id keeps its place
        self._filled: set[str] = set()
        self._puts = 0

    def known(self, but: str | None = None) -> DataFrame | None:
        """(id, ord) of all ids that JSON rows have brought, in any table (but one); None without any."""
        parts = [self.frames[n].select("id", "ord") for n in sorted(self._filled) if n != but] + self._removed
        if not parts:
            return None
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        return every.groupBy("id").agg(F.min("ord").alias("ord"))

    def create(self, table: TableDef | str) -> TableDef:
        """Declares a table; one of that name is replaced and is empty again."""
        table = declare(table) if isinstance(table, str) else table
        self.tables[table.name] = table
        self._filled.discard(table.name)
        empty = ", ".join(["id string", "ord bigint", *(f"`{f.name}` {f.spark_type.simpleString()}" for f in table.fields), "seq bigint"])
        self.frames[table.name] = self.spark.createDataFrame([], empty)
        return table

    def attach(self, table: TableDef | str, frame: DataFrame, id_column: str, order: str | None = None) -> TableDef:
        """A table over an existing frame with unique ids; its order column (or the id) stands for the order of ingest."""
        table = declare(table) if isinstance(table, str) else table
        self.tables[table.name] = table
        self._filled.discard(table.name)
        c = frame[order or id_column]
        cols = [frame[f.name].cast(f.spark_type).alias(f.name) for f in table.fields]
        self.frames[table.name] = limited(frame.select(frame[id_column].alias("id"), c.alias("ord"), *cols), table)
        return table

    def put(self, name: str, rows: DataFrame, body: str = "json", seq: str = "seq") -> DataFrame:
        """Upserts JSON rows in the order of seq; returns the refused rows (seq, id, reason).

        Absent members keep their values, but an absent bool becomes false. A row
        is taken or refused as a whole. With closed ids, ids that no table has are refused.
        Fields with a topk_limit lose what is beyond it after every put.
        """
        table = self.tables[name]
        if table.id_field is None:
            raise EngineError(f"{name} has no id")
        batch = upsert.parsed(rows, table, body, seq)
        if table.closed_ids:
            seen = self.known()
            seen = None if seen is None else seen.select("id", F.lit(True).alias("_seen"))
            batch = batch.withColumn("_seen", F.lit(None).cast("boolean")) if seen is None else batch.join(seen, "id", "left")
            refused = F.when(F.col("reason").isNull() & F.col("_seen").isNull(), "unknown id").otherwise(F.col("reason"))
            batch = batch.withColumn("reason", refused).drop("_seen")
        base = self._puts << 40
        self._puts += 1
        batch = batch.withColumn("seq", F.col("seq") + F.lit(base))
        frame = upsert.merged(self.frames[name] if name in self._filled else None, batch, table)
        others = self.known(but=name)
        if others is not None:  # an id that another table saw first has its place from there
            earlier = others.withColumnRenamed("ord", "_ord")
            frame = frame.join(earlier, "id", "left").withColumn("ord", F.least("ord", "_ord")).drop("_ord")
        self.frames[name] = limited(frame, table)
        self._filled.add(name)
        return batch.filter("reason is not null").select((F.col("seq") - F.lit(base)).alias("seq"), "id", "reason")

    def remove(self, name: str, gone: DataFrame) -> None:
        """Deletes the rows of these ids (column id)."""
        ids_ = gone.select(F.col("id").cast(self.frames[name].schema["id"].dataType))
        if name in self._filled:
            self._removed.append(self.frames[name].join(ids_, "id", "left_semi").select("id", "ord"))
        self.frames[name] = self.frames[name].join(ids_, "id", "left_anti")

    def compile(self, query: str) -> IdSet:
        return compile_query(query, self.tables)

    def select(self, query: str, offset: int = 0, limit: int = 100) -> Selection:
        """The ids that satisfy a query: a page of them in order, and all of them for the total."""
        matched = ids(self.compile(query), self.frames)
        return Selection(page(matched, offset, limit), matched)

    def all_ids(self, name: str) -> DataFrame:
        return self.frames[name].select("id", "ord")

    def between(self, name: str, field: str, low: float, high: float) -> DataFrame:
        """(id, ord) of rows whose number is from low to high, both included."""
        declared = self.tables[name].field(field)
        if declared is None or declared.kind not in (Kind.INT, Kind.FLOAT):
            raise TypeMismatch(f"{field} is no number of {name}")
        return self.frames[name].filter(F.col(f"`{field}`").between(F.lit(low), F.lit(high))).select("id", "ord")

    def point(self, name: str, id_: object) -> DataFrame:
        """The fields of one id."""
        return self.frames[name].filter(F.col("id") == F.lit(id_)).drop("ord", "seq")

    def save(self, path: str, names: list[str] | None = None) -> None:
        """Each table as Parquet, and a manifest with their declarations."""
        held = names or list(self.tables)
        for name in held:
            self.frames[name].write.mode("overwrite").parquet(f"{path}/{name}")
        about = {n: {"id": t.id_field, "closed": t.closed_ids, "fields": [[f.name, f.kind.value, f.low, f.high, f.topk_limit] for f in t.fields]} for n, t in self.tables.items() if n in held}
        self.spark.createDataFrame([(json.dumps({"partial": names is not None, "tables": about}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")

    def load(self, path: str) -> None:
        """Takes over a saved database; one of named tables only replaces these, which must exist here."""
        about = json.loads(self.spark.read.text(f"{path}/_manifest").first()[0])
        found = {n: TableDef(n, t["id"], tuple(FieldDef(a, Kind(k), lo, hi, top) for a, k, lo, hi, top in t["fields"]), t["closed"]) for n, t in about["tables"].items()}
        if about["partial"]:
            missing = [n for n in found if n not in self.tables]
            if missing:
                raise EngineError(f"no such table: {', '.join(missing)}")
        else:
            self.tables, self.frames, self._removed, self._filled = dict(found), {}, [], set()
        for n in found:
            self.frames[n] = self.spark.read.parquet(f"{path}/{n}")
            if "seq" in self.frames[n].columns:
                self._filled.add(n)
