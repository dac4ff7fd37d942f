"""Field kinds and table declarations."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class Kind(Enum):
    """Index kinds of a field, by the name used in a declaration."""

    ID = "id"
    SET = "set"
    WEIGHT_SET = "weight_set"
    MUTEX = "mutex"
    INT = "int"
    FLOAT = "float"
    BOOL = "bool"


_SPARK: dict[Kind, T.DataType] = {
    Kind.ID: T.StringType(),
    Kind.SET: T.ArrayType(T.StringType()),
    Kind.WEIGHT_SET: T.MapType(T.StringType(), T.FloatType()),
    Kind.MUTEX: T.StringType(),
    Kind.INT: T.LongType(),
    Kind.FLOAT: T.FloatType(),
    Kind.BOOL: T.BooleanType(),
}


@dataclass(frozen=True)
class FieldDef:
    """A declared field; low and high bound INT and FLOAT, topk_limit keeps the largest values only."""

    name: str
    kind: Kind
    low: float | None = None
    high: float | None = None
    topk_limit: int = 0

    @property
    def spark_type(self) -> T.DataType:
        return _SPARK[self.kind]


@dataclass(frozen=True)
class TableDef:
    """A declared table. closed_ids: only ids that the database knows already may be put or removed."""

    name: str
    id_field: str | None
    fields: tuple[FieldDef, ...]
    closed_ids: bool = False

    def field(self, name: str) -> FieldDef | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def json_schema(self) -> T.StructType:
        """Schema of one JSON row: the id as text, then the fields; other members are not read."""
        ids = [T.StructField(self.id_field, T.StringType())] if self.id_field else []
        return T.StructType(ids + [T.StructField(f.name, f.spark_type) for f in self.fields])


class EngineError(Exception):
    """An error with the code that callers test for."""

    code = 0

    def __init__(self, message: str, code: int | None = None):
        super().__init__(message)
        if code is not None:
            self.code = code


class ParseError(EngineError):
    """The text is no expression, query or declaration."""

    code = 10001


class UnknownFunction(EngineError):
    code = 10003


class UnknownField(EngineError):
    code = 10004


class TypeMismatch(EngineError):
    code = 10006


class ArityError(EngineError):
    code = 10007
