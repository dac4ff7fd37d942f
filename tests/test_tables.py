"""Upserts, statistics, stores, datasets, configuration and logs."""

import dataclasses
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators import dictionary, keyed, oplog, stats
from tesserae.operators.database import Database
from tesserae.sources import config, json_lines
from tesserae.types import EngineError, FieldDef, Kind, TableDef


def rows(spark, *objects):
    return spark.createDataFrame([(k, json.dumps(o) if not isinstance(o, str) else o) for k, o in enumerate(objects)], "seq long, json string")


def test_upsert(spark):
    db = Database(spark)
    db.create("t(id id, age int[1,150], city set, score float, gender mutex, child bool, w weight_set)")
    refused = db.put(
        "t",
        rows(
            spark, {"id": 1, "age": 5, "city": ["a", "a", "b"], "child": True, "w": {"x": 1.5}}, {"id": "2", "gender": "f"}, {"id": 1, "score": 2.5}, "not json", {"age": 3}, {"id": 3, "age": 0},
            {"id": 4, "age": "old"}, {"id": 1.5}, {"id": 2, "other": 1, "city": []},
        ),
    )
    assert {r.seq for r in refused.collect()} == {3, 4, 5, 6, 7}
    got = {r.id: r for r in db.frames["t"].collect()}
    assert set(got) == {"1", "2"}
    one = got["1"]
    assert (one.age, one.city, one.score, one.child, one.w) == (5, ["a", "b"], 2.5, False, {"x": 1.5})
    db.put("t", rows(spark, {"id": 1, "city": ["c"], "child": True}, {"id": 9, "age": 7}))
    got = {r.id: r for r in db.frames["t"].collect()}
    assert got["1"].city == ["c"] and got["1"].age == 5 and got["1"].child and got["9"].age == 7
    assert [r.id for r in db.select("t.child==0 || t.child==1").rows.collect()] == ["1", "2", "9"]
    db.remove("t", spark.createDataFrame([("1",)], "id string"))
    assert [r.id for r in db.select('t.gender!="zz"').rows.collect()] == ["2", "9"]


def test_ids_keep_their_place_over_tables(spark):
    db = Database(spark)
    db.create("a(id id, n int)")
    db.create("b(id id, n int)")
    db.put("a", rows(spark, {"id": "z", "n": 1}, {"id": "y", "n": 1}))
    db.put("b", rows(spark, {"id": "x", "n": 1}, {"id": "y", "n": 1}, {"id": "z", "n": 1}))
    assert [r.id for r in db.select("b.n==1").rows.collect()] == ["z", "y", "x"]
    db.remove("a", spark.createDataFrame([("z",)], "id string"))
    db.put("a", rows(spark, {"id": "w", "n": 1}, {"id": "z", "n": 1}))
    assert [r.id for r in db.select("a.n==1").rows.collect()] == ["z", "y", "w"]
    assert [r.id for r in db.select("a.n==1 || b.n==1").rows.collect()] == ["z", "y", "x", "w"]


def test_closed_ids(spark):
    db = Database(spark)
    db.create("a(id id, n int)")
    db.put("a", rows(spark, {"id": 1, "n": 2}))
    from tesserae.sources.ddl import declare

    db.create(declare("b(id id, n int)", closed_ids=True))
    refused = db.put("b", rows(spark, {"id": 1, "n": 3}, {"id": 2, "n": 3}))
    assert [(r.id, r.reason) for r in refused.collect()] == [("2", "unknown id")]
    assert [r.id for r in db.select("b.n==3 && a.n==2").rows.collect()] == ["1"]


def test_save_and_load(spark, tmp_path):
    db = Database(spark)
    db.create("a(id id, n int[0,9], s set)")
    db.put("a", rows(spark, {"id": "x", "n": 2, "s": ["p"]}))
    db.create("b(id id, f bool)")
    db.save(str(tmp_path / "all"))
    db.save(str(tmp_path / "part"), ["a"])
    other = Database(spark)
    with pytest.raises(EngineError):
        other.load(str(tmp_path / "part"))
    other.load(str(tmp_path / "all"))
    assert other.tables == db.tables and [r.id for r in other.select("a.n==2").rows.collect()] == ["x"]
    other.load(str(tmp_path / "part"))
    assert other.frames["a"].count() == 1


@pytest.mark.parametrize("values,want", [([3, 3, 3, 4, 6], ((3, 3), (6, 1))), ([4, 6], ((4, 1), (6, 1))), ([-5, -5, None, 7], ((-5, 2), (7, 1)))])
def test_extremes(spark, values, want):
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long")
    assert tuple(stats.extreme(df, "v", False).first()) == want[0] and tuple(stats.extreme(df, "v", True).first()) == want[1]
    least = min((v, i) for i, v in enumerate(values) if v is not None)[1]
    assert {r.id for r in stats.without_least(df, "v", "id").collect()} == set(range(len(values))) - {least}


def test_extremes_of_nothing(spark):
    assert stats.extreme(spark.createDataFrame([], "id long, v long"), "v", True).collect() == []


def test_top_k_with_ties(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(30)], "id long, v long")
    assert [r.id for r in stats.top(df, "v", "id", 4).collect()] == [27, 28, 29, 24]
    assert [r.id for r in stats.capped(df, "v", "id", 4).collect()] == [29, 28, 27, 26]


def test_inverted_index(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (40_000, ["a"]), (3, [])], "id long, s array<string>")
    assert {(r.value, r.n) for r in stats.cardinalities(df, "s", "id").collect()} == {("a", 2), ("b", 1)}
    assert stats.bit_depth(1, 150) == 8 and stats.bit_depth(5, 5) == 0


def test_float_image(spark):
    rnd = random.Random(1)
    floats = [struct.unpack("f", struct.pack("f", rnd.choice([-1, 1]) * rnd.random() * 10 ** rnd.randrange(-30, 30)))[0] for _ in range(500)] + [0.0, 1.0, -1.0, 2.0, 3.4e38, 1.17549435e-38, 1e-45]
    got = spark.createDataFrame([(x,) for x in floats], "x float").select("x", stats.order_image(F.col("x")).alias("i")).collect()
    for r in got:
        bits = struct.unpack("I", struct.pack("f", r.x))[0]
        assert r.i == (bits | 1 << 31 if r.x >= 0 else ~bits & 0xFFFFFFFF), r.x


def test_float_image_is_of_the_bits(spark):
    """Rows sort by it as the floats do; both zeros, values too small for a float, infinities and NaN of either sign have one."""
    rising = [-math.inf, -3.4e38, -1.0, -1.17549435e-38, -1e-45, -1e-60, 1e-60, 1e-45, 1.17549435e-38, 1.0, 3.4e38, math.inf]
    df = spark.createDataFrame([(x,) for x in [*rising, -0.0, 0.0, math.nan, -math.nan, None]], "x double")
    got = [(x, i) for x, i in df.select("x", stats.order_image(F.col("x")).alias("i")).collect()]
    for x, i in got[:-1]:
        (bits,) = struct.unpack("I", struct.pack("f", x))
        assert i == (~bits & 0xFFFFFFFF if bits >> 31 else bits | 1 << 31), x
    assert got[-1] == (None, None)
    falling = spark.createDataFrame([(x,) for x in reversed(rising)], "x double")
    assert [r.x for r in falling.orderBy(stats.order_image(F.col("x"))).collect()] == rising


def test_keyed_store(spark):
    w = spark.createDataFrame([("k", "f1", "a", 1, False), ("k", "f1", "b", 2, False), ("k", "f2", "c", 3, False), ("k", "f2", None, 4, True), ("j", "f1", "z", 1, False)], "key string, field string, value string, seq long, gone boolean")
    assert {(r.key, r.field, r.value) for r in keyed.state(w, ["key", "field"], deleted="gone").collect()} == {("k", "f1", "b"), ("j", "f1", "z")}
    for size in (8, 256):
        assert keyed.check_field_size(size) == size
    for size in (0, 12, 264):
        with pytest.raises(EngineError):
            keyed.check_field_size(size)


def test_ordered_map(spark):
    e = spark.createDataFrame([("k", i, f"value{i - 100}") for i in range(100, 110)] + [("other", 1, "x")], "key string, field long, value string")
    assert keyed.key_range(e, F.col("key") == "k", "field", 100, 105).count() == 6
    assert keyed.key_range(e, F.col("key") == "none", "field", 0, 1000).count() == 0
    popped = keyed.popped(e, "key", "field")
    assert keyed.first_field(popped, "key", "field", "value").collect()[0].value == "value1"
    assert [tuple(r) for r in keyed.sizes(popped, "key").collect()] == [("k", 9)]
    f = spark.createDataFrame([(5,), (-1,), (0,)], "field long")
    assert [r.field for r in f.orderBy(keyed.unsigned_order(F.col("field"))).collect()] == [0, 5, -1]


def test_expiry(spark):
    w = spark.createDataFrame([("a", "2024-01-01 00:00:00", 2), ("b", "2024-01-01 00:00:00", 0), ("c", "2024-01-01 00:00:02", 2)], "k string, t string, ttl int").withColumn("t", F.col("t").cast("timestamp"))
    e = keyed.rearmed(w.withColumn("expire_at", keyed.expiry(F.col("t"), F.col("ttl"))), ["k"])
    assert {r.k for r in keyed.alive(e, F.lit("2024-01-01 00:00:03").cast("timestamp")).collect()} == {"b", "c"}


def test_dictionary(spark, tmp_path):
    base = dictionary.build(spark.range(1, 1000).select("id", (F.col("id") + 100).alias("v"), F.lit(0).alias("s")).union(spark.createDataFrame([(5, 7, 1)], "id long, v long, s int")), "id", "v", "s")
    other = spark.range(900, 1100).select("id", F.lit(1).cast("long").alias("v"))
    m = {r.id: r.v for r in dictionary.merge(base, other, "id", "v").collect()}
    assert len(m) == 1099 and m[5] == 7 and m[950] == 1 and m[10] == 110
    probes = spark.createDataFrame([(1,), (5000,)], "id long")
    assert dictionary.get(probes, base, "id").count() == 1 and dictionary.get(probes, base, "id", misses=True).count() == 2
    assert [r.id for r in dictionary.exists(probes, base, "id").collect()] == [1]
    assert dictionary.commit(base, str(tmp_path / "d")).count() == 999
    with pytest.raises(Exception):
        dictionary.commit(base, str(tmp_path / "d"))


def test_log(spark, tmp_path):
    log = spark.createDataFrame([(1, "m", "+", 10.0), (2, "m", "*", 3.0), (3, "m", "-", 5.0), (4, "m", "/", 5.0), (1, "n", "/", 0.0)], "index long, m string, op string, v double")
    got = {r.m: r.state for r in oplog.replay(log, "m", "index", "op", "v").collect()}
    assert got == {"m": 5.0, "n": None}
    assert oplog.replay(log.filter("m = 'm'"), "m", "index", "op", "v", 30.0, after=2).first().state == 5.0
    one = log.filter("m = 'm'")
    oplog.append(one, str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    assert stored.count() == 4 and oplog.broken(stored).count() == 0
    assert oplog.gaps(one).count() == 0 and oplog.gaps(one.filter("index <> 2")).first()["n"] == 3


@dataclasses.dataclass
class Sample:
    a: int = 11
    b: float = 0.0
    c: bool = True
    d: str = ""
    e: list[int] = dataclasses.field(default_factory=lambda: [1, 2, 0, 5])
    f: int = dataclasses.field(default=1, metadata={"range": (0, 255)})


def test_config():
    got = config.from_yaml("a: 101\nb: 3.14\nc: false\nd: 'hello,world'\ne: [1, 2, 3, 4, 5]\n", Sample)
    assert (got.a, got.b, got.c, got.d, len(got.e)) == (101, 3.14, False, "hello,world", 5)
    assert config.from_json('{"a": "x", "f": 300, "if": 2.0}', Sample, {"if": "b"}) == Sample(b=2.0)
    assert config.from_toml("a = 5\ne = [1]", Sample) == Sample(a=5, e=[1])
    assert json.loads(config.to_json(Sample(a=0, c=False), without_defaults=True)) == {"e": [1, 2, 0, 5], "f": 1}


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"k": 1, "v": "a"}\n\nbroken\n{"k": 2, "v": "b"}\n')
    schema = T.StructType().add("k", "long").add("v", "string")
    base = json_lines.build(spark, str(tmp_path / "x.json"), schema, "k")
    inc = spark.createDataFrame([(2, "c"), (3, "d")], schema)
    last = spark.createDataFrame([(3, "e")], schema)
    assert {(r.k, r.v) for r in json_lines.merge(base, [inc, last], ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "e")}
    b = json_lines.register("letters", schema, "k")
    assert json_lines.BUILDERS["letters"] is b and b.lookup(base, inc).count() == 1
    df = spark.createDataFrame([(b"abc", "!!")], "raw binary, bad string")
    assert "\n" not in spark.range(1).select(json_lines.encoded(F.repeat(F.lit("ab"), 300).cast("binary")).alias("x")).first().x
    got = df.select(json_lines.decoded(json_lines.encoded(F.col("raw"))).alias("x"), json_lines.decoded(F.col("bad")).alias("y")).first()
    assert bytes(got.x) == b"abc" and got.y is None


def test_put_keeps_the_largest_values(spark):
    db = Database(spark)
    db.create(TableDef("t", "id", (FieldDef("n", Kind.INT, topk_limit=2), FieldDef("w", Kind.WEIGHT_SET, topk_limit=1), FieldDef("x", Kind.FLOAT))))
    db.put("t", rows(spark, {"id": "a", "n": 1, "w": {"k": 1.0, "l": 5.0}, "x": 1.0}, {"id": "b", "n": 3, "w": {"k": 2.0}, "x": 2.0}, {"id": "c", "n": 3, "w": {"l": 1.0}}, {"id": "d", "x": 3.0}))
    got = lambda: {r.id: (r.n, r.w, r.x) for r in db.frames["t"].collect()}
    assert got() == {"a": (None, {"l": 5.0}, 1.0), "b": (3, {"k": 2.0}, 2.0), "c": (3, {}, None), "d": (None, None, 3.0)}
    db.put("t", rows(spark, {"id": "d", "n": 4}, {"id": "a", "x": 9.0}))
    assert got() == {"a": (None, {"l": 5.0}, 9.0), "b": (None, {"k": 2.0}, 2.0), "c": (3, {}, None), "d": (4, None, 3.0)}
    assert {r.id for r in db.select("t.n>0").matched.collect()} == {"c", "d"}


def test_replay_composes_segments(spark, monkeypatch):
    """A machine's log folded in segments is what folding it entry by entry gives."""
    monkeypatch.setattr(oplog, "SEGMENT", 7)
    rnd = random.Random(5)
    entries = [(rnd.choice("abc"), i, rnd.choice("++--*/?"), float(rnd.choice([1, 2, 4, -2, 0.5]))) for i in range(300)] + [("z", 1, "+", 3.0), ("z", 2, "/", 0.0), ("z", 40, "+", 1.0)]
    want = {}
    for m, _, op, v in sorted(entries, key=lambda e: e[1]):
        x = want.get(m, 2.0)
        want[m] = None if x is None or op == "/" and v == 0 else x + v if op == "+" else x - v if op == "-" else x * v if op == "*" else x / v if op == "/" else x
    df = spark.createDataFrame(entries, "m string, i long, op string, v double").repartition(5)
    got = {r.m: r.state for r in oplog.replay(df, "m", "i", "op", "v", 2.0).collect()}
    assert got == {m: x if x is None else pytest.approx(x) for m, x in want.items()}


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("a", i, "+-*"[i % 3], float(i % 5)) for i in range(50)] + [("b", 45, "+", 2.0)], "m string, i long, op string, v double")
    whole = {r.m: r.state for r in oplog.replay(df, "m", "i", "op", "v").collect()}
    for last in (10, 30):
        oplog.snapshot(oplog.replay(df.filter(F.col("i") <= last), "m", "i", "op", "v"), last, str(tmp_path / "s"))
    assert {r.m: r.state for r in oplog.resumed(spark, str(tmp_path / "s"), df.filter("i > 20"), "m", "i", "op", "v").collect()} == whole


def test_saved_caches_expire(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, "x", 100), ("p", 2, "y", 200), ("q", 3, "z", None), ("q", 4, "w", 10)], "pool string, k long, v string, s long").withColumn("expire_at", F.timestamp_seconds("s")).drop("s")
    at = lambda s: F.timestamp_seconds(F.lit(s))
    keyed.save(df, str(tmp_path / "c"), at(50), "pool")
    back = lambda s: {r.k for r in keyed.load(spark, str(tmp_path / "c"), df.schema, at(s)).collect()}
    assert back(60) == {1, 2, 3} and back(150) == {2, 3} and back(900) == {3}
    assert {r.pool: r.n for r in keyed.pools(df, "pool").collect()} == {"p": 2, "q": 2}
    moved = keyed.expire_at(keyed.expire_at(df, F.col("k") == 1, at(500)), F.col("k") == 2, None)
    assert {r.k for r in keyed.alive(moved, at(300)).collect()} == {1, 2, 3}


def test_builder_by_name(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    json_lines.register("words", schema, "k")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k":1,"v":"a"}\n{"k":1,"v":"b"}\nbad\n{"v":"no key"}\n\n{"k":2,"v":"c"}\n')
    b = json_lines.builder("words")
    assert sorted(map(tuple, b.batch(spark, str(tmp_path / "in")).filter("k is not null").collect())) == [(1, "b"), (2, "c")]
    assert sorted(r.value for r in b.broken(spark, str(tmp_path / "in")).collect()) == ["bad", '{"v":"no key"}']
    b.stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    streamed = spark.read.schema(schema).parquet(str(tmp_path / "out")).filter("k is not null").select("k", "v")
    assert sorted(map(tuple, streamed.collect())) == [(1, "b"), (2, "c")]
    assert sorted(map(tuple, b.merged(streamed, [spark.createDataFrame([(2, "d"), (3, "e")], schema)]).collect())) == [(1, "b"), (2, "d"), (3, "e")]
    with pytest.raises(EngineError):
        json_lines.builder("none")


def test_between(spark):
    db = Database(spark)
    db.create("t(id id, n int, m mutex)")
    db.put("t", rows(spark, *({"id": i, "n": i} for i in range(6)), {"id": 9}))
    assert sorted(r.id for r in db.between("t", "n", 2, 4).collect()) == ["2", "3", "4"]
    with pytest.raises(EngineError):
        db.between("t", "m", 1, 2)


def test_session_state_and_compaction(spark, tmp_path):
    """Keys live until no write has come for a day; compacted batches give the same state."""
    from tesserae.streaming import ingest

    stamp = lambda day, hour: f"2024-01-{day:02d} {hour:02d}:00:00"
    writes = [(1, stamp(1, 0)), (1, stamp(1, 20)), (1, stamp(5, 0)), (2, stamp(2, 3)), (9, "2200-01-01 00:00:00")]
    df = spark.createDataFrame(writes, "k long, at string").withColumn("ts", F.col("at").cast("timestamp")).drop("at")
    df.write.parquet(str(tmp_path / "in"))
    spans = ingest.live_spans(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "k", "1 day", "1 hour")
    out = str(tmp_path / "out")
    spans.writeStream.outputMode("append").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.k, str(r.born), str(r.expires), r.writes) for r in spark.read.parquet(out).collect())
    assert got == [(1, stamp(1, 0), stamp(2, 20), 2), (1, stamp(5, 0), stamp(6, 0), 1), (2, stamp(2, 3), stamp(3, 3), 1)]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("k", "v", "seq")])
    for n in range(3):
        spark.createDataFrame([(1, n, n), (n, 7, n)], schema).write.parquet(str(tmp_path / f"applied/batch={n}"))
    ingest.compact(spark, str(tmp_path / "applied"), str(tmp_path / "small"), ["k"], "seq", schema)
    state = lambda p: sorted(map(tuple, ingest.upsert_state(spark, str(tmp_path / p), ["k"], "seq", schema).filter("k <> 1").collect()))
    assert state("small") == state("applied") == [(0, 7, 0), (2, 7, 2)]
