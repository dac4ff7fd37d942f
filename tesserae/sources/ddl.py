"""One-line table declarations: ``name(field type[min,max], ...)``."""

from __future__ import annotations

import re

from ..types import FieldDef, Kind, ParseError, TableDef

_HEAD = re.compile(r"\s*([A-Za-z_]\w*)\s*\(")
_FIELD = re.compile(r"\s*([A-Za-z_]\w*)\s+([A-Za-z_]+)\s*(?:\[\s*([^,\]]+?)\s*,\s*([^,\]]+?)\s*\])?\s*([,)])")


def declare(text: str, closed_ids: bool = False) -> TableDef:
    """The table of a declaration. Types are in lower or in upper case as a whole; text after the closing bracket is not read; at most one field is the id."""
    head = _HEAD.match(text)
    if head is None:
        raise ParseError(f"no table name in {text!r}")
    at, ids, fields = head.end(), [], []
    while True:
        m = _FIELD.match(text, at)
        if m is None:
            raise ParseError(f"no field at {at} of {text!r}")
        name, kind, low, high, end = m.groups()
        if kind not in (kind.lower(), kind.upper()) or kind.lower() not in {k.value for k in Kind}:
            raise ParseError(f"unknown type {kind}")
        if kind.lower() == "id":
            ids.append(name)
        else:
            try:
                fields.append(FieldDef(name, Kind(kind.lower()), *(None if x is None else float(x) for x in (low, high))))
            except ValueError as e:
                raise ParseError(f"bounds of {name}: {e}") from e
        at = m.end()
        if end == ")":
            break
    if len(ids) > 1:
        raise ParseError("more than one id")
    return TableDef(head[1], ids[0] if ids else None, tuple(fields), closed_ids)
