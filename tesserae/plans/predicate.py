"""Index queries: text -> predicates by table, and id sets where tables meet.

A leaf is a predicate on one table. Leaves of one table stay one ``Column``, so
a whole single-table query is one filter that reaches the scan; only where
tables meet are there semi joins, anti joins and unions of ids. Leaves are
two-valued: a missing value never satisfies a comparison of numbers, and
satisfies != of sets, maps, words and booleans.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import FieldDef, Kind, TableDef, TypeMismatch, UnknownField, UnknownFunction
from .grammar import INDEX, Binary, Call, Cond, Lit, Node, Ref, Unary, Var, folded, parse


@dataclass(frozen=True)
class Leaf:
    """Rows of a table that satisfy a two-valued or null-rejecting condition. strict: the condition is never null."""

    table: str
    condition: Column
    strict: bool

    def sure(self) -> Column:
        return self.condition if self.strict else F.coalesce(self.condition, F.lit(False))


@dataclass(frozen=True)
class Both:
    parts: tuple[IdSet, ...]


@dataclass(frozen=True)
class Either:
    parts: tuple[IdSet, ...]


@dataclass(frozen=True)
class Minus:
    keep: IdSet
    drop: IdSet


IdSet = Leaf | Both | Either | Minus

_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}


def compare(field: FieldDef, op: str, value: object, column: Column | None = None) -> tuple[Column, bool]:
    """(condition, whether it is never null) of `field op value`; a missing number fails every comparison."""
    c = F.col(field.name) if column is None else column
    kind = field.kind
    if kind in (Kind.SET, Kind.MUTEX, Kind.WEIGHT_SET):
        if op not in ("==", "!=") or not isinstance(value, str):
            raise TypeMismatch(f"{field.name} {op} {value!r}: {kind.value} fields take == and != of a text")
        test = c == value if kind is Kind.MUTEX else F.array_contains(c, value) if kind is Kind.SET else F.map_contains_key(c, value)
        return (test, False) if op == "==" else (~F.coalesce(test, F.lit(False)), True)
    if kind is Kind.BOOL:
        if op not in ("==", "!=") or not isinstance(value, int) or isinstance(value, bool):
            raise TypeMismatch(f"{field.name} {op} {value!r}: bool fields take == and != of 0 or 1")
        yes = (value != 0) == (op == "==")
        return (c, False) if yes else (~F.coalesce(c, F.lit(False)), True)
    if isinstance(value, (bool, str)) or not isinstance(value, (int, float)) or kind is Kind.INT and not isinstance(value, int):
        raise TypeMismatch(f"{field.name} {op} {value!r}: not a value of {kind.value}")
    v = F.lit(value) if kind is Kind.INT else F.lit(value).cast("float")
    tests = {"==": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}
    return tests[op], False


class _Compiler:
    def __init__(self, tables: Mapping[str, TableDef]):
        self.tables = tables

    def field(self, ref: Ref) -> tuple[str, FieldDef]:
        if len(ref.path) != 2 or ref.path[0] not in self.tables:
            raise UnknownField(f"{'.'.join(ref.path)}: table.field of a known table expected")
        found = self.tables[ref.path[0]].field(ref.path[1])
        if found is None:
            raise UnknownField(f"{'.'.join(ref.path)}: no such field")
        return ref.path[0], found

    def value(self, node: Node) -> object:
        """A constant, or an id set."""
        if isinstance(node, Lit):
            return node.value
        if isinstance(node, Ref):
            return self.field(node)
        if isinstance(node, (Call, Var)):
            raise UnknownFunction("index queries have no functions and no variables")
        if isinstance(node, Unary):
            v = self.value(node.arg)
            if isinstance(v, bool) or not isinstance(v, (int, float)):
                raise TypeMismatch(f"unary {node.op} is for numbers")
            return -v if node.op == "-" else v
        if isinstance(node, Cond):
            test = self.value(node.test)
            return self.value(node.yes if test else node.no) if isinstance(test, bool) else test
        a, b = self.value(node.left), self.value(node.right)
        if node.op in _FLIP and isinstance(a, tuple) != isinstance(b, tuple):
            (table, field), other, op = (a, b, node.op) if isinstance(a, tuple) else (b, a, _FLIP[node.op])
            if isinstance(other, (Leaf, Both, Either, Minus)):
                raise TypeMismatch("a set of ids is not a value")
            return Leaf(table, *compare(field, op, other))
        sets = (Leaf, Both, Either, Minus)
        if node.op in ("&&", "||", "&&!") and isinstance(a, sets) and isinstance(b, sets):
            return self.joined(node.op, a, b)
        if isinstance(a, (*sets, tuple)) or isinstance(b, (*sets, tuple)):
            raise TypeMismatch(f"{node.op} is not defined here")
        return folded(node.op, a, b)

    @staticmethod
    def joined(op: str, a: IdSet, b: IdSet) -> IdSet:
        if isinstance(a, Leaf) and isinstance(b, Leaf) and a.table == b.table:
            if op == "&&":  # null-rejecting conditions stay as they are, so that they reach the scan
                return Leaf(a.table, a.condition & b.condition, a.strict and b.strict)
            return Leaf(a.table, a.sure() | b.sure() if op == "||" else a.sure() & ~b.sure(), True)
        if op == "&&!":
            return Minus(a, b)
        kind = Both if op == "&&" else Either
        parts: list[IdSet] = []
        for p in (*(a.parts if isinstance(a, kind) else (a,)), *(b.parts if isinstance(b, kind) else (b,))):
            same = next((i for i, q in enumerate(parts) if isinstance(p, Leaf) and isinstance(q, Leaf) and q.table == p.table), None)
            if same is None:
                parts.append(p)
            else:
                parts[same] = _Compiler.joined(op, parts[same], p)
        return kind(tuple(parts))


def compile_query(text: str, tables: Mapping[str, TableDef]) -> IdSet:
    """The id set of a query."""
    out = _Compiler(tables).value(parse(text, INDEX))
    if not isinstance(out, (Leaf, Both, Either, Minus)):
        raise TypeMismatch("the query is not a condition on a field")
    return out


def ids(node: IdSet, frames: Mapping[str, DataFrame]) -> DataFrame:
    """The columns id and ord of an id set; every frame has both, ids unique."""
    if isinstance(node, Leaf):
        return frames[node.table].filter(node.condition).select("id", "ord")
    if isinstance(node, Minus):
        return ids(node.keep, frames).join(ids(node.drop, frames).select("id"), "id", "left_anti")
    first, *rest = (ids(p, frames) for p in node.parts)
    for other in rest:
        first = first.join(other.select("id"), "id", "left_semi") if isinstance(node, Both) else first.union(other)
    return first if isinstance(node, Both) else first.groupBy("id").agg(F.min("ord").alias("ord"))
