"""Expressions over nested records, compiled to typed Spark columns.

Whole-stage code generation takes the place of a just-in-time compiler: an
expression is one ``Column`` of built-in operators, and registered functions are
Python functions from columns to a column, inlined into the same code.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.grammar import EXPRESSION, Binary, Call, Cond, Lit, Node, Ref, Unary, Var, parse
from ..types import ArityError, EngineError, TypeMismatch, UnknownField, UnknownFunction

MAX_ARGS = 10


@dataclass(frozen=True)
class Function:
    """build: columns to a column; returns: "int", "double", "bool" or "string"; args: how many, or None for any."""

    build: Callable[..., Column]
    returns: str
    args: int | None = None


@dataclass(frozen=True)
class Typed:
    """A column and its kind: int, double, bool, string, or opaque (arrays, maps, structs and others)."""

    column: Column
    kind: str


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _typed(column: Column, kind: T.DataType) -> Typed:
    if isinstance(kind, _WHOLE):
        return Typed(column.cast("long"), "int")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return Typed(column.cast("double"), "double")
    if isinstance(kind, T.BooleanType):
        return Typed(column, "bool")
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return Typed(column, "string")
    return Typed(column, "opaque")


def _literal(value: Any) -> Typed:
    if isinstance(value, bool):
        return Typed(F.lit(value), "bool")
    if isinstance(value, int):
        return Typed(F.lit(value).cast("long"), "int")
    if isinstance(value, float):
        return Typed(F.lit(value), "double")
    if isinstance(value, str):
        return Typed(F.lit(value), "string")
    if isinstance(value, Column):
        return Typed(value, "opaque")
    raise TypeMismatch(f"{value!r} is no value")


def lookup(params: Mapping[str, Any], path: tuple[str, ...]) -> Any:
    """A parameter by its dotted path; the whole path may be one key."""
    if ".".join(path) in params:
        return params[".".join(path)]
    at: Any = params
    for name in path:
        if not isinstance(at, Mapping) or name not in at:
            raise UnknownField(f"${'.'.join(path)} is not set")
        at = at[name]
    return at


class Compiler:
    """Compiles for rows of one schema; $names come from params as literals, functions from the registry."""

    def __init__(self, schema: T.StructType, functions: Mapping[str, Function] | None = None, params: Mapping[str, Any] | None = None):
        self.schema, self.functions, self.params = schema, dict(functions or {}), params or {}

    def compile(self, text: str) -> Column:
        return self.typed(parse(text, EXPRESSION)).column

    def kind(self, text: str) -> str:
        return self.typed(parse(text, EXPRESSION)).kind

    def typed(self, node: Node) -> Typed:
        match node:
            case Lit(value):
                return _literal(value)
            case Var(path):
                return _literal(lookup(self.params, path))
            case Ref(path):
                return self.member(path)
            case Call(name, args):
                return self.call(name, args)
            case Unary(op, arg):
                return self.unary(op, self.typed(arg))
            case Cond(test, yes, no):
                return self.cond(self.typed(test), self.typed(yes), self.typed(no))
            case Binary(op, left, right):
                return self.binary(op, self.typed(left), self.typed(right))
        raise EngineError(f"{node!r}")

    def member(self, path: tuple[str, ...]) -> Typed:
        """A nested member; a null on the way makes it null."""
        at: T.DataType = self.schema
        for name in path:
            field = next((f for f in at.fields if f.name == name), None) if isinstance(at, T.StructType) else None
            if field is None:
                raise UnknownField(f"no member {'.'.join(path)}")
            at = field.dataType
        return _typed(F.col(".".join(f"`{p}`" for p in path)), at)

    def call(self, name: str, args: tuple[Node, ...]) -> Typed:
        if name not in self.functions:
            raise UnknownFunction(f"no function {name}")
        f = self.functions[name]
        if len(args) > MAX_ARGS or f.args is not None and len(args) != f.args:
            raise ArityError(f"{name} takes {MAX_ARGS if f.args is None else f.args} arguments, not {len(args)}")
        return Typed(f.build(*[self.typed(a).column for a in args]), f.returns)

    @staticmethod
    def unary(op: str, x: Typed) -> Typed:
        if op == "!":
            if x.kind != "bool":
                raise TypeMismatch("! is for conditions")
            return Typed(~x.column, "bool")
        if x.kind not in ("int", "double"):
            raise TypeMismatch(f"unary {op} is for numbers")
        return Typed(-x.column, x.kind) if op == "-" else x

    @staticmethod
    def cond(test: Typed, yes: Typed, no: Typed) -> Typed:
        if test.kind != "bool":
            raise TypeMismatch("the test of ?: is no condition")
        if {yes.kind, no.kind} == {"int", "double"}:
            yes, no = (Typed(x.column.cast("double"), "double") for x in (yes, no))
        if yes.kind != no.kind:
            raise TypeMismatch(f"?: of {yes.kind} and {no.kind}")
        return Typed(F.when(test.column, yes.column).otherwise(no.column), yes.kind)

    @staticmethod
    def binary(op: str, a: Typed, b: Typed) -> Typed:
        numbers = a.kind in ("int", "double") and b.kind in ("int", "double")
        x, y = a.column, b.column
        if op in ("&&", "||"):
            if a.kind != "bool" or b.kind != "bool":
                raise TypeMismatch(f"{op} is for conditions")
            # the right side is evaluated only where the left one leaves it open
            return Typed(F.when(x, y).otherwise(F.lit(False)) if op == "&&" else F.when(x, F.lit(True)).otherwise(y), "bool")
        if op in "+-*/%":
            if not numbers or op == "%" and "double" in (a.kind, b.kind):
                raise TypeMismatch(f"{op} of {a.kind} and {b.kind}")
            whole = a.kind == b.kind == "int"
            if op in "/%":  # integers divide towards zero; a zero divisor gives null
                zero = F.when(y != 0, y)
                return Typed(F.call_function("div", x, zero) if op == "/" and whole else x / zero if op == "/" else x % zero, "int" if whole else "double")
            return Typed(x + y if op == "+" else x - y if op == "-" else x * y, "int" if whole else "double")
        if not (numbers or a.kind == b.kind and a.kind in ("string", "bool")):
            raise TypeMismatch(f"{op} of {a.kind} and {b.kind}")
        tests = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}
        return Typed(tests[op], "bool")


def compile_expression(text: str, schema: T.StructType, functions: Mapping[str, Function] | None = None, params: Mapping[str, Any] | None = None) -> Column:
    """The column of an expression."""
    return Compiler(schema, functions, params).compile(text)


def evaluate(text: str, params: Mapping[str, Any], functions: Mapping[str, Callable] | None = None) -> Any:
    """The value of an expression without record members, on the driver; names read as parameters. For gates and settings of graphs."""
    from ..plans.grammar import folded

    def go(n: Node) -> Any:
        match n:
            case Lit(value):
                return value
            case Var(path) | Ref(path):
                return lookup(params, path)
            case Call(name, args):
                if name not in (functions or {}):
                    raise UnknownFunction(f"no function {name}")
                return functions[name](*[go(a) for a in args])
            case Unary(op, arg):
                v = go(arg)
                return not v if op == "!" else -v if op == "-" else v
            case Cond(test, yes, no):
                return go(yes) if go(test) else go(no)
            case Binary("&&", left, right):
                return bool(go(left)) and bool(go(right))
            case Binary("||", left, right):
                return bool(go(left)) or bool(go(right))
            case Binary(op, left, right):
                a, b = go(left), go(right)
                return a == b if op == "==" and isinstance(a, bool) and isinstance(b, bool) else folded(op, a, b)

    return go(parse(text, EXPRESSION))
