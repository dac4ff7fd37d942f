"""Configuration structs: JSON, TOML and YAML text to dataclasses with defaults, and JSON columns.

A member that is missing, of another type or out of its range keeps its default.
"""

from __future__ import annotations

import dataclasses
import json
import tomllib
import types
import typing
from collections.abc import Mapping
from typing import Any, TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Config = TypeVar("Config")
_MISS = object()


def _fit(value: Any, kind: Any) -> Any:
    """The value as the annotated kind, or _MISS."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (types.UnionType, typing.Union):
        return next((x for a in args if (x := _fit(value, a)) is not _MISS), _MISS)
    if kind in (None, type(None)):
        return None if value is None else _MISS
    if dataclasses.is_dataclass(kind):
        return read(value, kind) if isinstance(value, Mapping) else _MISS
    if origin in (list, tuple, set):
        if not isinstance(value, list):
            return _MISS
        items = [_fit(v, args[0]) for v in value]
        return _MISS if _MISS in items else origin(items)
    if origin is dict:
        if not isinstance(value, Mapping):
            return _MISS
        items = {k: _fit(v, args[1]) for k, v in value.items()}
        return _MISS if _MISS in items.values() else items
    if kind is Any:
        return value
    if kind is float:
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else _MISS
    return value if isinstance(value, kind) and (kind is bool or not isinstance(value, bool)) else _MISS


def read(members: Mapping[str, Any], kind: type[Config], names: Mapping[str, str] | None = None) -> Config:
    """A dataclass from named members. names: member -> field, for members that are no field names.

    A field's metadata may have a range (low, high) of whole numbers.
    """
    hints = typing.get_type_hints(kind)
    back = {v: k for k, v in (names or {}).items()}
    out = {}
    for f in dataclasses.fields(kind):
        value = members.get(back.get(f.name, f.name), _MISS)
        got = _MISS if value is _MISS else _fit(value, hints[f.name])
        low, high = f.metadata.get("range", (None, None))
        if got is not _MISS and low is not None and not low <= got <= high:
            got = _MISS
        if got is not _MISS:
            out[f.name] = got
    return kind(**out)


def from_json(text: str, kind: type[Config], names: Mapping[str, str] | None = None) -> Config:
    return read(json.loads(text), kind, names)


def from_toml(text: str, kind: type[Config], names: Mapping[str, str] | None = None) -> Config:
    return read(tomllib.loads(text), kind, names)


def from_yaml(text: str, kind: type[Config], names: Mapping[str, str] | None = None) -> Config:
    import yaml

    got = yaml.safe_load(text)
    return read({k: v for k, v in (got or {}).items() if v is not None}, kind, names)


def to_json(value: Any, without_defaults: bool = False) -> str:
    """JSON text; without defaults, members that are zero, empty or false are left out."""

    def plain(v: Any) -> Any:
        if dataclasses.is_dataclass(v):
            items = {f.name: plain(getattr(v, f.name)) for f in dataclasses.fields(v)}
            return {k: x for k, x in items.items() if not without_defaults or x not in (0, 0.0, "", False, [], {}, None)}
        if isinstance(v, Mapping):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, (list, tuple, set)) else v

    return json.dumps(plain(value))


def parse_column(text: Column, schema: T.StructType, defaults: Mapping[str, Any] | None = None) -> Column:
    """A struct of a JSON column; members that are missing or of another type have their defaults, members out of a narrow whole type's range too."""
    wide = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.AtomicType) else f.dataType) for f in schema.fields])
    got = F.from_json(text, wide)
    cols = []
    for f in schema.fields:
        c = got[f.name].try_cast(f.dataType) if isinstance(f.dataType, T.AtomicType) else got[f.name]
        if defaults and f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        cols.append(c.alias(f.name))
    return F.struct(*cols)


def write_column(columns: Mapping[str, tuple[Column, T.DataType]], without_defaults: bool = True) -> Column:
    """JSON text of named columns; without defaults, zero, empty and false members are left out."""
    out = []
    for name, (c, kind) in columns.items():
        if without_defaults:
            empty = F.size(c) == 0 if isinstance(kind, (T.ArrayType, T.MapType)) else ~c if isinstance(kind, T.BooleanType) else c == F.lit("" if isinstance(kind, T.StringType) else 0)
            c = F.when(~empty, c)
        out.append(c.alias(name))
    return F.to_json(F.struct(*out), {"ignoreNullFields": "true"})
