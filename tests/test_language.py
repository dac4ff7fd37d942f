"""The grammar, the expression compiler and the index query compiler."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.expressions import Compiler, Function, evaluate
from tesserae.operators.database import Database
from tesserae.plans.grammar import EXPRESSION, INDEX, Binary, Lit, Unary, parse
from tesserae.sources.ddl import declare
from tesserae.types import ArityError, Kind, ParseError, TypeMismatch, UnknownField, UnknownFunction


def test_logical_operators_share_one_level():
    a = parse("a || b && c")
    assert a.op == "&&" and a.left.op == "||"
    assert parse("a.b==1 &&! a.c==2", INDEX).op == "&&!"
    b = parse("a && !b", EXPRESSION)
    assert isinstance(b.right, Unary)
    assert parse("x &&!y", EXPRESSION).op == "&&"


def test_precedence_of_modulo_is_additive():
    assert parse("7%2*3") == Binary("%", Lit(7), Binary("*", Lit(2), Lit(3)))
    assert parse("truest") == parse(" truest ")


@pytest.mark.parametrize("text", ["1 2", "a ==", "(1", 'a == "x', "1 ? 2", "a..b", ""])
def test_whole_text_must_parse(text):
    with pytest.raises(ParseError):
        parse(text)


RECORD = T.StructType().add("ship", T.StructType().add("load", "double").add("flag", "string").add("port", T.StructType().add("depth", "integer").add("code", "string")))
RECORD = RECORD.add("crane", T.StructType().add("load", "double").add("flag", "string")).add("tide", "long").add("berth", "string").add("fees", T.MapType(T.StringType(), T.DoubleType()))


@pytest.fixture(scope="module")
def record(spark):
    row = Row(ship=Row(load=7.5, flag="north", port=Row(depth=12, code="q9")), crane=Row(load=0.25, flag="south"), tide=-6, berth="west", fees={"toll": 4.5})
    return spark.createDataFrame([row], RECORD)


FUNCTIONS = {
    "rest": Function(lambda a, b: a % b, "int", 2),
    "twice": Function(lambda a: a * 2, "int", 1),
    "boom": Function(lambda: F.raise_error(F.lit("called")).cast("boolean"), "bool", 0),
    "toll": Function(lambda m: m["toll"], "double", 1),
}


@pytest.mark.parametrize(
    "text,want",
    [
        ('berth=="west"', True), ("2!=2", False), ("false", False), ("true", True), ('ship.flag != "south" && (crane.load > 3 || crane.flag == "south")', True),
        ("ship.load * 2 + rest(29, 8) - crane.load + (tide < 0 ? 1 : 2)", 20.75), ("twice($step)", 14), ("ship.port.depth <= 11 ? 5:6", 6), ("tide > 0 && boom()", False),
        ("tide < 0 || boom()", True), ('$word=="a b" && $half==0.5 && ($step%4==3)', True), ("toll(fees)", 4.5), ("-9/4", -2), ("-9%4", -1), ("1/0", None), ("-tide", 6), ("!(tide==-6)", False), ("3<4==true", True),
    ],
)
def test_expression(record, text, want):
    c = Compiler(RECORD, FUNCTIONS, {"step": 7, "word": "a b", "half": 0.5})
    got = record.select(c.compile(text).alias("x")).first().x
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


@pytest.mark.parametrize(
    "text,error",
    [("nope()", UnknownFunction), ("rest(1)", ArityError), ("ship.nope", UnknownField), ("$gone", UnknownField), ('1+"a"', TypeMismatch), ("1?2:3", TypeMismatch), ('tide==5?1:"a"', TypeMismatch), ("1.5%2", TypeMismatch)],
)
def test_errors_come_at_compile_time(text, error):
    with pytest.raises(error):
        Compiler(RECORD, FUNCTIONS).compile(text)


def test_null_on_the_way(spark):
    df = spark.createDataFrame([(None,)], T.StructType().add("a", T.StructType().add("b", "integer")))
    assert df.select(Compiler(df.schema).compile("a.b+1").alias("x")).first().x is None


def test_expression_is_compiled_code(record):
    plan = record.select(Compiler(RECORD, FUNCTIONS).compile("tide*2+rest(tide,7)").alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_evaluate_on_the_driver():
    assert evaluate("$n>10 && flag==true", {"n": 11, "flag": True}) is True
    assert evaluate("n/2*3", {"n": 7}) == 9


def test_declaration():
    t = declare("boats(hull id, knots int[1,40], ports set, draft FLOAT, rig mutex, moored bool, cargo weight_set) and more")
    assert t.id_field == "hull" and [f.kind for f in t.fields] == [Kind.INT, Kind.SET, Kind.FLOAT, Kind.MUTEX, Kind.BOOL, Kind.WEIGHT_SET] and t.fields[0].high == 40
    assert declare("t(a int)").id_field is None
    for bad in ("t(a Int)", "t(a id, b id)", "t(a text)", "t", "t()", "t(a int[x,2])"):
        with pytest.raises(ParseError):
            declare(bad)


@pytest.fixture(scope="module")
def db(spark):
    rnd = random.Random(3)
    db, data = Database(spark), {}
    for name, n in (("a", 60), ("b", 50)):
        rows = []
        for i in rnd.sample(range(80), n):
            maybe = lambda v: None if rnd.random() < 0.2 else v
            rows.append((i, maybe(rnd.randrange(10)), maybe(rnd.choice("xyz")), maybe(rnd.sample("pqr", 2)), maybe(rnd.random() < 0.5), maybe(rnd.randrange(8) / 2), maybe({rnd.choice("pqr"): 1.0})))
        df = spark.createDataFrame(rows, "id long, n long, m string, s array<string>, f boolean, x float, w map<string,float>")
        db.attach(f"{name}(id id, n int, m mutex, s set, f bool, x float, w weight_set)", df, "id")
        data[name] = {r[0]: dict(zip(("n", "m", "s", "f", "x", "w"), r[1:])) for r in rows}
    return db, data


def _leaf(rnd, table):
    field = rnd.choice("nmsfxw")
    if field in "nx":
        op, value = rnd.choice(["==", "!=", "<", "<=", ">", ">="]), rnd.randrange(10) if field == "n" else rnd.randrange(8) / 2
        tests = {"==": lambda v: v == value, "!=": lambda v: v != value, "<": lambda v: v < value, "<=": lambda v: v <= value, ">": lambda v: v > value, ">=": lambda v: v >= value}
        return f"{table}.{field}{op}{value}", lambda r: r[field] is not None and tests[op](r[field])
    op = rnd.choice(["==", "!="])
    if field == "f":
        value = rnd.randrange(2)
        return f"{table}.f{op}{value}", lambda r: bool(r["f"]) == ((value != 0) == (op == "=="))
    value = rnd.choice("xyz" if field == "m" else "pqr")
    return f'{table}.{field}{op}"{value}"', lambda r: (r[field] is not None and (r[field] == value if field == "m" else value in r[field])) == (op == "==")


@pytest.mark.parametrize("seed", range(25))
def test_random_queries(db, seed):
    """Trees of leaves and && || &&! over two tables against sets of ids."""
    db, data = db
    rnd = random.Random(seed)

    def tree(depth):
        if depth == 0 or rnd.random() < 0.3:
            table = rnd.choice("ab")
            text, test = _leaf(rnd, table)
            return text, {i for i, r in data[table].items() if test(r)}
        (ta, a), (tb, b), op = tree(depth - 1), tree(depth - 1), rnd.choice(["&&", "||", "&&!"])
        return f"({ta}){op}({tb})", a & b if op == "&&" else a | b if op == "||" else a - b

    text, want = tree(3)
    got = [r.id for r in db.select(text).matched.collect()]
    assert sorted(got) == sorted(want), text


def test_index_errors(db):
    db, _ = db
    for text, error in (("a.zz==1", UnknownField), ("c.n==1", UnknownField), ("a.n==1.5", TypeMismatch), ("a.m<3", TypeMismatch), ("a.f==true", TypeMismatch), ("1==1", TypeMismatch), ("f(1)", UnknownFunction), ("a.n", TypeMismatch)):
        with pytest.raises(error):
            db.select(text)


def test_paging(db):
    db, data = db
    want = sorted(i for i, r in data["a"].items() if r["n"] is not None and r["n"] >= 0)
    assert [r.id for r in db.select("a.n>=0", -5, 0).rows.collect()] == want[:100]
    assert [r.id for r in db.select("a.n>=0", 10, 5).rows.collect()] == want[10:15]
    assert db.select("a.n>=0", 1000, 5).rows.collect() == [] and db.select("a.n>=0").total == len(want)
