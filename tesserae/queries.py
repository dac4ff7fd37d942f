"""The catalogue of queries over the driver's tables, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

import dataclasses
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.expressions import Compiler, Function
from .operators import dictionary, keyed, oplog, stats
from .operators.database import Database, page
from .plans.flow import Manager, Registry, params_of_text
from .sources import config, json_lines, upsert
from .sources.ddl import declare
from .streaming import ingest
from .types import EngineError

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ORDERS = "orders(o_orderkey id, o_orderstatus mutex, o_totalprice float, o_orderpriority mutex)"
PART = "part(p_partkey id, p_brand mutex, p_size int[1,50], p_retailprice float)"
CUSTOMER = "customer(c_custkey id, c_mktsegment mutex, c_acctbal float, c_nationkey int)"
DOCUMENTS = "documents(doc_id id, lang mutex, source mutex, n_chars int)"
LABELS = "labels(doc_id id, quality bool, toxic bool)"
USERS = "users(user_id id, tags set, w weight_set, n int, vmax float, churned bool)"
#: A user's tags are the types of which they have this many events or more.
TAG_EVENTS = 12


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user of events: frequent types as tags, weights by type of those, events, greatest value, any frequent error."""
    by_type = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"), F.max("value").alias("m"))
    often = F.col("c") >= TAG_EVENTS
    return by_type.groupBy("user_id").agg(
        F.sort_array(F.collect_set(F.when(often, F.col("event_type")))).alias("tags"),
        F.map_from_entries(F.collect_list(F.when(often, F.struct("event_type", F.col("c").cast("float"))))).alias("w"),
        F.sum("c").alias("n"), F.max("m").cast("float").alias("vmax"), F.max((F.col("event_type") == "error") & often).alias("churned"),
    )


def database(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    """The named tables, attached over their files; a doc_id of labels and documents is one id."""
    db = Database(spark)
    declared = {"orders": ORDERS, "part": PART, "customer": CUSTOMER, "documents": DOCUMENTS, "labels": LABELS, "users": USERS}
    for n in names:
        table = declare(declared[n])
        df = users(spark, sf_dir) if n == "users" else read(spark, sf_dir, n)
        df = df.withColumns({f.name: F.col(f.name) != 0 for f in table.fields if f.kind.value == "bool" and dict(df.dtypes)[f.name] != "boolean"})
        db.attach(table, df, table.id_field)
    return db


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _selection(name: str, table: str | tuple[str, ...], text: str, sql: str) -> None:
    tables = (table,) if isinstance(table, str) else table

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return database(spark, sf_dir, *tables).select(text).matched.select("id")

    run.__name__, run.__doc__ = name, f"All ids of `{text}`."
    query(sql)(run)


_ID = {"orders": "o_orderkey", "part": "p_partkey", "customer": "c_custkey", "documents": "doc_id", "labels": "doc_id"}


def _where(table: str, condition: str) -> str:
    return f"SELECT {_ID[table]} AS id FROM {table} WHERE {condition}"


_USERS_SQL = f"""WITH t AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2),
u AS (SELECT user_id, sum(c) AS n, count(*) FILTER (event_type = 'error' AND c >= {TAG_EVENTS}) AS errors, count(*) FILTER (event_type = 'purchase' AND c >= {TAG_EVENTS}) AS buys FROM t GROUP BY 1) """

for _name, _table, _text, _condition in (
    ("sel_mutex_eq", "orders", 'orders.o_orderstatus=="F"', "o_orderstatus = 'F'"),
    ("sel_mutex_neq", "orders", 'orders.o_orderstatus!="F"', "NOT coalesce(o_orderstatus = 'F', false)"),
    ("sel_int_eq", "part", "part.p_size==11", "p_size = 11"),
    ("sel_int_neq", "part", "part.p_size!=11", "p_size <> 11"),
    ("sel_int_lt", "part", "part.p_size<11", "p_size < 11"),
    ("sel_int_lte", "part", "part.p_size<=11", "p_size <= 11"),
    ("sel_int_gt", "part", "part.p_size>39", "p_size > 39"),
    ("sel_int_gte", "part", "part.p_size>=39", "p_size >= 39"),
    ("sel_float_eq", "part", "part.p_retailprice==1000.5", "CAST(p_retailprice AS FLOAT) = CAST(1000.5 AS FLOAT)"),
    ("sel_float_lt", "customer", "customer.c_acctbal<0.0", "CAST(c_acctbal AS FLOAT) < 0"),
    ("sel_float_lte", "customer", "customer.c_acctbal<=100.25", "CAST(c_acctbal AS FLOAT) <= CAST(100.25 AS FLOAT)"),
    ("sel_float_gt", "customer", "customer.c_acctbal>9000", "CAST(c_acctbal AS FLOAT) > 9000"),
    ("sel_float_gte", "customer", "customer.c_acctbal>=-500.25", "CAST(c_acctbal AS FLOAT) >= CAST(-500.25 AS FLOAT)"),
    ("sel_bool_eq1", "labels", "labels.toxic==1", "toxic <> 0"),
    ("sel_bool_eq0", "labels", "labels.quality==0", "NOT coalesce(quality <> 0, false)"),
    ("sel_bool_neq0", "labels", "labels.quality!=0", "quality <> 0"),
    ("sel_flip_literal", "part", "25<part.p_size", "p_size > 25"),
    ("sel_and_or_leftassoc", "orders", 'orders.o_orderstatus=="F" || orders.o_orderstatus=="P" && orders.o_totalprice>100000', "(o_orderstatus = 'F' OR o_orderstatus = 'P') AND CAST(o_totalprice AS FLOAT) > 100000"),
    ("sel_and_not", "orders", 'orders.o_totalprice>100000 &&! orders.o_orderstatus=="F"', "CAST(o_totalprice AS FLOAT) > 100000 AND NOT coalesce(o_orderstatus = 'F', false)"),
    ("sel_const_fold", "part", "part.p_size<2*3+10/4-1", "p_size < 7"),
    ("sel_ternary", "part", "2>1?part.p_size==3:part.p_size==4", "p_size = 3"),
    ("sel_unknown_value", "orders", 'orders.o_orderstatus=="ZZZ"', "o_orderstatus = 'ZZZ'"),
    ("sel_bench", "labels", "labels.toxic==1 && labels.quality!=0", "toxic <> 0 AND quality <> 0"),
):
    _selection(_name, _table, _text, _where(_table, _condition))

for _name, _text, _condition in (
    ("sel_set_contains", 'users.tags=="error"', "errors > 0"),
    ("sel_set_not_contains", 'users.tags!="error"', "errors = 0"),
    ("sel_weight_key", 'users.w=="purchase"', "buys > 0"),
    ("sel_weight_not_key", 'users.w!="purchase"', "buys = 0"),
    ("sel_user_mix", 'users.n>=40 && users.tags=="error" || users.churned==0', "(n >= 40 AND errors > 0) OR errors = 0"),
):
    _selection(_name, "users", _text, f"{_USERS_SQL} SELECT user_id AS id FROM u WHERE {_condition}")

for _name, _text, _sql in (
    ("cross_and", 'documents.lang=="en" && labels.toxic==1', "SELECT doc_id AS id FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic <> 0)"),
    ("cross_or", 'documents.lang=="es" || labels.quality==0', "SELECT doc_id AS id FROM documents WHERE lang = 'es' UNION SELECT doc_id FROM labels WHERE quality = 0"),
    ("cross_not", 'documents.lang=="en" &&! labels.quality==1', "SELECT doc_id AS id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality <> 0)"),
    (
        "cross_mixed", 'documents.n_chars>1000 && labels.quality==1 && documents.lang!="en"',
        "SELECT doc_id AS id FROM documents WHERE n_chars > 1000 AND lang <> 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality <> 0)",
    ),
):
    _selection(_name, ("documents", "labels"), _text, _sql)


@query("SELECT p_partkey AS id FROM part WHERE p_size BETWEEN 5 AND 15")
def sel_int_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "part").between("part", "p_size", 5, 15).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND CAST(o_totalprice AS FLOAT) > 100000 ORDER BY 1 LIMIT 100 OFFSET 100")
def sel_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 100 ids."""
    return database(spark, sf_dir, "orders").select('orders.o_orderstatus=="F" && orders.o_totalprice>100000', 100, 100).rows


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND CAST(o_totalprice AS FLOAT) > 100000 ORDER BY 1 LIMIT 100")
def sel_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "orders").select('orders.o_orderstatus=="F" && orders.o_totalprice>100000').rows


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F' AND CAST(o_totalprice AS FLOAT) > 100000")
def sel_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "orders").select('orders.o_orderstatus=="F" && orders.o_totalprice>100000').total_frame()


@query("SELECT o_orderkey AS id FROM orders")
def sel_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "orders").all_ids("orders").select("id")


@query("SELECT p_partkey AS id, p_brand, CAST(p_size AS BIGINT) AS p_size, CAST(p_retailprice AS FLOAT) AS p_retailprice FROM part WHERE p_partkey = 7")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "part").point("part", 7)


@query("SELECT max(p_size) AS v, count(*) FILTER (p_size = (SELECT max(p_size) FROM part)) AS n FROM part")
def agg_max_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.extreme(read(spark, sf_dir, "part"), "p_size", True)


@query("SELECT min(p_size) AS v, count(*) FILTER (p_size = (SELECT min(p_size) FROM part)) AS n FROM part")
def agg_min_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.extreme(read(spark, sf_dir, "part"), "p_size", False)


@query("WITH f AS (SELECT p_size FROM part WHERE p_size > 10 AND p_retailprice > 905) SELECT min(p_size) AS v, count(*) FILTER (p_size = (SELECT min(p_size) FROM f)) AS n FROM f")
def agg_min_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.extreme(read(spark, sf_dir, "part"), "p_size", False, (F.col("p_size") > 10) & (F.col("p_retailprice") > 905))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey <> (SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1)")
def remove_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.without_least(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 10)


@query("SELECT p_partkey, p_size FROM (SELECT *, row_number() OVER (ORDER BY p_size DESC, p_partkey DESC) AS r FROM part) WHERE r <= 25")
def topk_limit_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.capped(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "p_partkey", 25)


@query(
    f"""SELECT tag, user_id, weight FROM (SELECT event_type AS tag, user_id, CAST(count(*) AS FLOAT) AS weight, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id DESC) AS r
    FROM events GROUP BY 1, 2 HAVING count(*) >= {TAG_EVENTS}) WHERE r <= 5"""
)
def topk_limit_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five heaviest users of every tag."""
    entries = users(spark, sf_dir).select("user_id", F.explode("w").alias("tag", "weight"))
    return stats.capped_by_key(entries, "tag", "weight", "user_id", 5).select("tag", "user_id", "weight")


@query(f"SELECT event_type AS value, count(*) AS n FROM (SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING count(*) >= {TAG_EVENTS}) GROUP BY 1")
def inv_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cardinalities(users(spark, sf_dir), "tags", "user_id")


@query("SELECT CAST(b AS INTEGER) AS b, CAST(sum(((p_size - 1) >> CAST(b AS INTEGER)) & 1) AS BIGINT) AS n FROM part, range(6) r(b) GROUP BY b")
def bitslice_popcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.slice_counts(read(spark, sf_dir, "part"), "p_size", 1, 50)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as upserts of a user: a purchase sets the score, a click the tags, a view the child flag."""
    e = read(spark, sf_dir, "events").withColumn("seq", _micros() * 1000 + F.col("event_id") % 1000)
    value = F.col("value").cast("float")
    body = F.struct(
        F.col("user_id").alias("id"), F.when(F.col("event_type") == "purchase", value).alias("score"), F.when(F.col("event_type") == "click", F.array("event_type")).alias("tags"),
        F.when(F.col("event_type") == "view", F.lit(True)).alias("child"), F.col("event_type").alias("kind"),
    )
    return e.select("seq", F.to_json(body).alias("json"))


@query(
    """WITH e AS (SELECT *, epoch_us(ts) * 1000 + event_id % 1000 AS seq FROM events)
    SELECT CAST(user_id AS VARCHAR) AS id, round(arg_max(CAST(value AS FLOAT), seq) FILTER (event_type = 'purchase'), 3) AS score, arg_max(event_type, seq) AS kind,
        coalesce(arg_max(event_type = 'view', seq), false) AS child, count(*) FILTER (event_type = 'click') > 0 AS clicked FROM e GROUP BY user_id"""
)
def upsert_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent members keep their values, an absent bool becomes false."""
    db = Database(spark)
    db.create("u(id id, score float, tags set, child bool, kind mutex)")
    db.put("u", _changes(spark, sf_dir))
    return db.frames["u"].select("id", F.round("score", 3).alias("score"), "kind", "child", (F.size(F.coalesce("tags", F.array())) > 0).alias("clicked"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.latest_rows(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "orders")
    db.remove("orders", read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct())
    return db.frames["orders"].select("id", "o_orderstatus")


def _scratch(spark: SparkSession) -> str:
    """A new folder for a query's files in the cluster's shared folder; without one set, in the warehouse of a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tesserae-scratch"
    path = f"{folder}/tesserae-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


@query("SELECT p_partkey AS id, p_brand, CAST(p_size AS BIGINT) AS p_size, CAST(p_retailprice AS FLOAT) AS p_retailprice FROM part")
def save_load_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, path = database(spark, sf_dir, "part", "orders"), _scratch(spark)
    db.save(path)
    other = Database(spark)
    other.load(path)
    return other.frames["part"].select("id", "p_brand", "p_size", "p_retailprice")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS TINYINT) AS tiny, 'none' AS other FROM events")
def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by a schema; missing ones have their defaults, numbers out of range none."""
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("tiny", T.ByteType()), T.StructField("other", T.StringType())])
    text = F.regexp_replace("props", r"\}$", ', "tiny": 300}')
    return read(spark, sf_dir, "events").select("event_id", config.parse_column(text, schema, {"other": "none"}).alias("v")).select("event_id", "v.*")


@query("""SELECT doc_id, '{' || concat_ws(',', CASE WHEN quality <> 0 THEN '"quality":' || quality END, CASE WHEN toxic <> 0 THEN '"toxic":true' END) || '}' AS json FROM labels""")
def json_write_nodefaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON without members that are zero, empty or false."""
    p = read(spark, sf_dir, "labels")
    members = {"quality": (F.col("quality"), T.IntegerType()), "toxic": (F.col("toxic") != 0, T.BooleanType())}
    return p.select("doc_id", config.write_column(members).alias("json"))


@query(
    """SELECT k, v FROM (SELECT c_custkey AS k, 1 AS s, c_name AS v FROM customer UNION ALL SELECT c_custkey, 2, upper(c_mktsegment) FROM customer WHERE c_nationkey < 10
    UNION ALL SELECT c_custkey, 3, lower(c_mktsegment) FROM customer WHERE c_nationkey < 3) QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC) = 1"""
)
def dataset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines: a base and two increments, of which the last that has a key wins."""
    c, path = read(spark, sf_dir, "customer"), _scratch(spark)
    parts = (("base", c, F.col("c_name")), ("one", c.filter("c_nationkey < 10"), F.upper("c_mktsegment")), ("two", c.filter("c_nationkey < 3"), F.lower("c_mktsegment")))
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    for name, df, v in parts:
        json_lines.append(df.select(F.col("c_custkey").alias("k"), v.alias("v")), f"{path}/{name}", truncate=True)
    base, *more = (json_lines.build(spark, f"{path}/{name}", schema, "k") for name, _, _ in parts)
    return json_lines.merge(base, more, ["k"])


def _codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").filter("p_size < 20").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey AS k, p_brand AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 20")
def dict_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_partkey").alias("k"))
    return dictionary.get(probes, _codebook(spark, sf_dir), "k")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def dict_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"))
    return dictionary.exists(probes, _codebook(spark, sf_dir), "k", absent=True)


@query("SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT p_partkey AS k, p_brand AS v FROM part WHERE p_size < 20) a FULL JOIN (SELECT p_partkey AS k, p_type AS v FROM part WHERE p_size > 10) b ON a.k = b.k")
def dict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = read(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("v"))
    return dictionary.merge(_codebook(spark, sf_dir), other, "k", "v")


_LAST = "arg_max({0}, epoch_us(ts)::HUGEINT * 1000000000 + event_id)"


def _order() -> Column:
    """The order of events: by time, those of one time by id."""
    return F.struct(_micros().alias("at"), F.col("event_id").alias("id"))


@query(f"SELECT user_id AS k, {_LAST.format('event_type')} AS v FROM events GROUP BY user_id HAVING {_LAST.format('event_type')} <> 'error'")
def kv_set_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of every key; an error event deletes its key."""
    writes = read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("v"), _order().alias("seq"), (F.col("event_type") == "error").alias("gone"))
    return keyed.state(writes, ["k"], deleted="gone").select("k", "v")


@query("SELECT user_id AS k FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1 HAVING max(ts) + INTERVAL 1 DAY > TIMESTAMP '2024-01-15'")
def kv_ttl_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a fixed clock finds alive; every write arms its key for a day."""
    now = F.lit("2024-01-15").cast("timestamp")
    writes = read(spark, sf_dir, "events").filter(F.col("ts") <= now).select(F.col("user_id").alias("k"), keyed.expiry(F.col("ts"), 86_400).alias("expire_at"))
    return keyed.alive(keyed.rearmed(writes, ["k"]), now).select("k")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered maps by user: field event_id, value event_type."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("field"), F.col("event_type").alias("value"))


@query("SELECT user_id AS key, event_id AS field, event_type AS value FROM events WHERE user_id = 5 AND event_id BETWEEN 100 AND 5000 ORDER BY event_id")
def omap_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.key_range(_entries(spark, sf_dir), F.col("key") == 5, "field", 100, 5000)


@query("SELECT user_id AS key, min(event_id) AS field, arg_min(event_type, event_id) AS value FROM events GROUP BY 1")
def omap_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.first_field(_entries(spark, sf_dir), "key", "field", "value")


@query("SELECT user_id AS key, event_id AS field, event_type AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1")
def omap_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.popped(_entries(spark, sf_dir), "key", "field")


@query("SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1")
def omap_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.sizes(_entries(spark, sf_dir), "key")


@query(f"SELECT event_type AS field, {_LAST.format('event_id')} AS value FROM events WHERE user_id = 7 GROUP BY 1")
def hmap_get_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of one hash map, each with its last value."""
    e = read(spark, sf_dir, "events").filter("user_id = 7")
    writes = e.select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.col("event_id").alias("value"), _order().alias("seq"))
    return keyed.state(writes, ["key", "field"]).select("field", "value")


def _expression(name: str, table: str, keep: tuple[str, ...], texts: dict[str, str], sql: str, functions: dict[str, Function] | None = None, params: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = records(spark, sf_dir) if table == "records" else read(spark, sf_dir, table)
        c = Compiler(df.schema, functions, params)
        return df.select(*keep, *[c.compile(t).alias(n) for n, t in texts.items()])

    run.__name__, run.__doc__ = name, "; ".join(texts.values())
    query(sql)(run)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nested records."""
    p = read(spark, sf_dir, "part")
    sub = F.struct(F.col("p_size").alias("vv"), (F.col("p_partkey") % 100).alias("uv"), F.col("p_type").alias("id"))
    return p.select(F.col("p_partkey").alias("key"), F.struct(F.col("p_retailprice").alias("score"), F.col("p_brand").alias("id"), F.col("p_partkey").alias("vv"), sub.alias("sub")).alias("item"))


_LINE = ("l_orderkey", "l_linenumber", "l_partkey")
_expression(
    "expr_arith", "lineitem", _LINE, {"x": "l_quantity * 2 + l_linenumber - 1.5", "y": "l_orderkey + l_partkey * 3 - 7"},
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 + l_linenumber - 1.5::DOUBLE AS x, l_orderkey + l_partkey * 3 - 7 AS y FROM lineitem",
)
_expression(
    "expr_div_int", "lineitem", _LINE, {"x": "(l_partkey - 1000) / 7", "y": "l_orderkey / (l_linenumber - 2)", "z": "l_quantity / 4"},
    "SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey - 1000) // 7 AS x, l_orderkey // nullif(l_linenumber - 2, 0) AS y, l_quantity / 4 AS z FROM lineitem",
)
_expression("expr_mod", "lineitem", _LINE, {"x": "(l_partkey - 1000) % 7"}, "SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey - 1000) % 7 AS x FROM lineitem")
_expression("expr_neg", "lineitem", _LINE, {"x": "-l_partkey + +5", "y": "!(l_linenumber>3)"}, "SELECT l_orderkey, l_linenumber, l_partkey, -l_partkey + 5 AS x, NOT (l_linenumber > 3) AS y FROM lineitem")
_expression(
    "expr_compare", "lineitem", _LINE, {"a": "l_linenumber>=3", "b": "l_quantity<25", "c": "l_linenumber!=2", "d": "(l_linenumber>3)==(l_quantity>25)"},
    "SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber >= 3 AS a, l_quantity < 25 AS b, l_linenumber <> 2 AS c, (l_linenumber > 3) = (l_quantity > 25) AS d FROM lineitem",
)
_expression(
    "expr_logic", "lineitem", _LINE, {"a": "l_linenumber==1 || l_quantity>25 && l_linenumber<5"},
    "SELECT l_orderkey, l_linenumber, l_partkey, (l_linenumber = 1 OR l_quantity > 25) AND l_linenumber < 5 AS a FROM lineitem",
)
_expression(
    "expr_ternary", "lineitem", _LINE, {"a": "l_linenumber>3?100:l_quantity", "b": 'l_returnflag=="R"?"back":"kept"'},
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber > 3 THEN 100.0::DOUBLE ELSE l_quantity END AS a, CASE WHEN l_returnflag = 'R' THEN 'back' ELSE 'kept' END AS b FROM lineitem",
)
_expression(
    "expr_string_cmp", "lineitem", _LINE, {"a": 'l_returnflag<"N"', "b": "l_returnflag>=l_linestatus"},
    "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag < 'N' AS a, l_returnflag >= l_linestatus AS b FROM lineitem",
)
_expression(
    "expr_nested", "records", ("key",), {"a": "item.sub.vv*2+item.vv", "b": "item.sub.vv>25?item.score:0", "c": 'item.id=="Brand#11"'},
    "SELECT p_partkey AS key, p_size * 2 + p_partkey AS a, CASE WHEN p_size > 25 THEN p_retailprice ELSE 0 END AS b, p_brand = 'Brand#11' AS c FROM part",
)
_expression(
    "expr_dynamic_var", "records", ("key",), {"a": "item.sub.vv>$limits.low && $flag==true", "b": "item.vv%$n"},
    "SELECT p_partkey AS key, p_size > 20 AS a, p_partkey % 13 AS b FROM part", params={"limits": {"low": 20}, "flag": True, "n": 13},
)
_FUNCTIONS = {
    "zero": Function(lambda: F.lit(100).cast("long"), "int", 0),
    "one": Function(lambda a: a + 100, "int", 1),
    "two": Function(lambda a, b: a * 2 + b, "int", 2),
    "three": Function(lambda a, b, c: a + b * c, "int", 3),
}
_expression("udf_0args", "records", ("key",), {"a": "zero()+item.sub.vv"}, "SELECT p_partkey AS key, CAST(100 + p_size AS BIGINT) AS a FROM part", _FUNCTIONS)
_expression("udf_1args", "records", ("key",), {"a": "one(item.sub.vv)-1"}, "SELECT p_partkey AS key, CAST(p_size + 99 AS BIGINT) AS a FROM part", _FUNCTIONS)
_expression("udf_2args", "records", ("key",), {"a": "two(item.sub.vv,item.vv)"}, "SELECT p_partkey AS key, p_size * 2 + p_partkey AS a FROM part", _FUNCTIONS)
_expression(
    "udf_3args", "records", ("key",), {"a": "three(item.vv,item.sub.vv,one(item.sub.uv))"}, "SELECT p_partkey AS key, p_partkey + p_size * (p_partkey % 100 + 100) AS a FROM part", _FUNCTIONS
)
_expression(
    "expr_bench", "lineitem", _LINE, {"x": "1+2*3.1-6/3+zero()-two(3,l_linenumber)+l_quantity+((l_partkey>100||l_partkey<10)?10000:0)"},
    "SELECT l_orderkey, l_linenumber, l_partkey, 1 + 2 * 3.1::DOUBLE - 6 // 3 + 100 - (6 + l_linenumber) + l_quantity + CASE WHEN l_partkey > 100 OR l_partkey < 10 THEN 10000 ELSE 0 END AS x FROM lineitem", _FUNCTIONS,
)


OPS = Registry()


@OPS.op("big")
def big_orders(orders: DataFrame, params) -> DataFrame:
    return orders.filter(F.col("o_totalprice") > params["least"])


@OPS.op("small")
def small_orders(orders: DataFrame, params) -> DataFrame:
    return orders.filter(F.col("o_totalprice") <= params["least"])


@OPS.op("counts")
def by_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@OPS.op("merged")
def tagged(parts: dict[str, DataFrame]) -> DataFrame:
    """Several data as one, with their names."""
    out = None
    for name, df in sorted(parts.items()):
        df = df.select("o_orderkey", "o_orderstatus", F.lit(name).alias("part"))
        out = df if out is None else out.unionByName(df)
    return out


@OPS.op("never")
def failing(orders: DataFrame) -> DataFrame:
    raise ValueError("always")


@OPS.op("limit")
def counter(limit: int | None = None) -> int:
    return (limit or 0) + 1


FLOWS = """
strict_dsl = false
[[config_setting]]
name = "strict_prices"
cond = '$mode=="strict"'
[[graph]]
name = "linear"
[[graph.vertex]]
processor = "big_orders"
args = { least = 100000 }
[[graph.vertex]]
processor = "by_status"
input = [{ field = "rows", id = "big", required = true }]
[[graph]]
name = "diamond"
[[graph.vertex]]
processor = "big_orders"
args = { least = 200000 }
[[graph.vertex]]
processor = "small_orders"
args = { least = 50000 }
[[graph.vertex]]
processor = "tagged"
input = [{ field = "parts", aggregate = ["big", "small"] }]
[[graph]]
name = "branch"
[[graph.vertex]]
id = "test"
cond = "$n>10"
if = ["big_orders"]
else = ["small_orders"]
[[graph.vertex]]
processor = "big_orders"
output = [{ field = "big", id = "chosen_big" }]
args = { least = 100000 }
[[graph.vertex]]
processor = "small_orders"
output = [{ field = "small", id = "chosen_small" }]
args = { least = 100000 }
[[graph.vertex]]
processor = "tagged"
input = [{ field = "parts", aggregate = ["chosen_big", "chosen_small"] }]
[[graph]]
name = "selected"
[[graph.vertex]]
processor = "big_orders"
start = true
select_args = [{ match = "strict_prices", args = { least = 300000 } }, { match = "$n>100", args = { least = 200000 } }]
args = { least = 100000 }
[[graph]]
name = "gated"
[[graph.vertex]]
processor = "big_orders"
expect_config = "strict_prices"
args = { least = 100000 }
[[graph.vertex]]
processor = "small_orders"
expect_config = "!strict_prices"
args = { least = 100000 }
[[graph.vertex]]
processor = "tagged"
input = [{ field = "parts", aggregate = ["big", "small"] }]
[[graph]]
name = "nested"
[[graph.vertex]]
id = "inner"
cluster = "."
graph = "linear"
[[graph.vertex]]
id = "again"
processor = "by_status"
input = [{ field = "rows", id = "big" }]
output = [{ field = "counts", id = "outer" }]
deps_on_ok = ["inner"]
[[graph]]
name = "skipped"
[[graph.vertex]]
processor = "big_orders"
args = { least = 100000 }
[[graph.vertex]]
processor = "small_orders"
expect = "$n>100"
input = [{ field = "orders", extern = true }]
output = [{ field = "small", id = "final", move_from_when_skipped = "big" }]
deps = ["big_orders"]
args = { least = 1 }
[[graph.vertex]]
processor = "by_status"
input = [{ field = "rows", id = "final" }]
[[graph]]
name = "failed"
[[graph.vertex]]
processor = "failing"
ignore_processor_execute_error = false
successor_on_err = ["small_orders"]
successor_on_ok = ["big_orders"]
[[graph.vertex]]
processor = "small_orders"
output = [{ field = "small", id = "kept_small" }]
args = { least = 100000 }
[[graph.vertex]]
processor = "big_orders"
output = [{ field = "big", id = "kept_big" }]
args = { least = 100000 }
[[graph.vertex]]
processor = "tagged"
input = [{ field = "parts", aggregate = ["kept_big", "kept_small"] }]
[[graph]]
name = "step"
[[graph.vertex]]
processor = "counter"
start = true
input = [{ field = "limit", extern = true }]
[[graph]]
name = "loop"
[[graph.vertex]]
id = "repeat"
cluster = "."
graph = "step"
while = "limit<5"
[[graph.vertex]]
processor = "big_orders"
deps_on_ok = ["repeat"]
args = { least = 100000 }
"""


def _flow(name: str, graph: str, out: str, sql: str | None, **params) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = Manager(OPS)
        m.load(FLOWS, "flows")
        return m.run("flows", graph, {"orders": read(spark, sf_dir, "orders"), "limit": 0}, {"mode": "free", "n": 1} | params)[out]

    run.__name__, run.__doc__ = name, f"Datum {out} of graph {graph}."
    query(sql)(run)


_PARTS = "SELECT o_orderkey, o_orderstatus, '{}' AS part FROM orders WHERE o_totalprice {}"
_COUNTS = "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1"
_flow("flow_linear", "linear", "counts", _COUNTS)
_flow("flow_diamond", "diamond", "merged", _PARTS.format("big", "> 200000") + " UNION ALL " + _PARTS.format("small", "<= 50000"))
_flow("flow_branch_ok", "branch", "merged", _PARTS.format("chosen_big", "> 100000"), n=11)
_flow("flow_branch_err", "branch", "merged", _PARTS.format("chosen_small", "<= 100000"), n=10)
_flow("flow_select_args", "selected", "big", "SELECT * FROM orders WHERE o_totalprice > 200000", n=101)
_flow("flow_expect_config", "gated", "merged", _PARTS.format("big", "> 100000"), mode="strict")
_flow("flow_subgraph", "nested", "outer", _COUNTS)
_flow("flow_skip_forward", "skipped", "counts", _COUNTS)
_flow("flow_on_err", "failed", "merged", _PARTS.format("kept_small", "<= 100000"))
_flow("flow_aggregate", "diamond", "merged", _PARTS.format("big", "> 200000") + " UNION ALL " + _PARTS.format("small", "<= 50000"))
_flow("flow_while", "loop", "big", "SELECT * FROM orders WHERE o_totalprice > 100000")


@query("SELECT 'run' AS phase, 3 AS n UNION ALL SELECT 'skip', 1")
def flow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices by phase, from the events of a run."""
    m = Manager(OPS)
    m.load(FLOWS, "flows")
    done = m.run("flows", "branch", {"orders": read(spark, sf_dir, "orders")}, {"mode": "free", "n": 11})
    rows = spark.createDataFrame([(e.graph, e.vertex, e.phase, e.end - e.start) for e in done.events], "graph string, vertex string, phase string, seconds double")
    return rows.groupBy("phase").agg(F.count("*").cast("int").alias("n"))


def _entries_of_log(e: DataFrame) -> DataFrame:
    """Events as additions and subtractions of whole numbers, by user."""
    return e.select("user_id", F.col("event_id").alias("i"), F.when(F.col("event_type") == "error", "-").otherwise("+").alias("op"), (F.col("event_id") % 97).alias("v"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries_of_log(read(spark, sf_dir, "events"))


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN -(event_id % 97) ELSE event_id % 97 END) AS DOUBLE) AS state FROM events GROUP BY 1")
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.replay(_log(spark, sf_dir), "user_id", "i", "op", "v")


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN -(event_id % 97) ELSE event_id % 97 END) AS BIGINT) AS state FROM events GROUP BY 1")
def log_replay_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.replay_sum(_log(spark, sf_dir), "user_id", "op", "v")


_WRITES = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("expire_at", T.TimestampType())])


def _applied(spark: SparkSession, sf_dir: str, change: Callable[[DataFrame], DataFrame]) -> str:
    """Streams the changed events through micro-batches; the folder of applied batches."""
    path, source = _scratch(spark), _scratch(spark)
    read(spark, sf_dir, "events").repartition(4, "event_id").write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    ingest.append_batches(stream, f"{path}/applied", f"{path}/checkpoint", change).awaitTermination()
    return f"{path}/applied"


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """The events as writes of their users, each alive for a day."""
    return _applied(spark, sf_dir, lambda b: b.select(F.col("user_id").alias("k"), F.col("event_type").alias("v"), _micros().alias("seq"), keyed.expiry(F.col("ts"), 86_400).alias("expire_at")))


@query("SELECT user_id AS k, arg_max(event_type, ts) AS v FROM events GROUP BY 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.upsert_state(spark, _streamed(spark, sf_dir), ["k"], "seq", _WRITES).select("k", "v")


@query("SELECT user_id AS k FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 1 DAY > TIMESTAMP '2024-01-30'")
def stream_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.expiring_state(spark, _streamed(spark, sf_dir), ["k"], "seq", _WRITES, F.lit("2024-01-30").cast("timestamp")).select("k")


@query("SELECT user_id AS k, arg_max(event_id, ts) AS v FROM events GROUP BY 1 ORDER BY v DESC, k DESC LIMIT 20")
def stream_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest current values of a stream of upserts."""
    path = _applied(spark, sf_dir, lambda b: b.select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), _micros().alias("seq")))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("k", "v", "seq")])
    return ingest.capped_state(spark, path, "k", "v", "seq", schema, 20).select("k", "v")


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN -(event_id % 97) ELSE event_id % 97 END) + 5 AS DOUBLE) AS state FROM events WHERE event_id > 100 GROUP BY 1")
def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed log entries after a snapshot's index, folded from its state."""
    path = _applied(spark, sf_dir, _entries_of_log)
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("i", T.LongType()), T.StructField("op", T.StringType()), T.StructField("v", T.LongType())])
    return ingest.log_state(spark, path, "user_id", "i", "op", "v", schema, 5.0, 100)


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by type of a stream, each given once its window is closed; a last row far ahead closes all windows of events."""
    source, path = _scratch(spark), _scratch(spark)
    e = read(spark, sf_dir, "events").select("ts", "event_type")
    far = spark.sql("SELECT TIMESTAMP_NTZ '2200-01-01 00:00:00' AS ts, 'end' AS event_type").select(F.col("ts").cast(e.schema["ts"].dataType), "event_type")
    e.union(far).write.parquet(source)
    stream = spark.readStream.schema(e.schema).parquet(source)
    counts = ingest.windowed_counts(stream, "ts", "event_type", "1 day", "1 day")
    q = counts.writeStream.outputMode("append").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


@query(
    """SELECT c_custkey AS id, c_acctbal < 0 AS negative, CASE WHEN b >= 0 THEN b + 2147483648 ELSE -1 - b END AS image
    FROM (SELECT c_custkey, c_acctbal, CAST(CAST(CAST(CAST(c_acctbal AS FLOAT) AS BIT) AS INTEGER) AS BIGINT) AS b FROM customer)"""
)
def float_order_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unsigned image of every float, which sorts as the floats do."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 0).alias("negative"), stats.order_image(F.col("c_acctbal").cast("float")).alias("image"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS id, {_LAST.format('event_type')} AS key, CAST({_LAST.format('event_id % 97')} AS FLOAT) AS weight FROM events GROUP BY user_id")
def upsert_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weight set is replaced as a whole by the last row that has one."""
    e = read(spark, sf_dir, "events").withColumn("seq", _micros() * 1000 + F.col("event_id") % 1000)
    body = F.struct(F.col("user_id").alias("id"), F.create_map("event_type", F.col("event_id") % 97).alias("w"))
    db = Database(spark)
    db.create("u(id id, w weight_set)")
    db.put("u", e.select("seq", F.to_json(body).alias("json")))
    return db.frames["u"].select("id", F.explode("w").alias("key", "weight"))


def _part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JSON rows, every tenth with a text for its size."""
    size = F.when(F.col("p_partkey") % 10 == 0, F.lit('"many"')).otherwise(F.col("p_size").cast("string"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit('{"id":'), F.col("p_partkey"), F.lit(',"size":'), size, F.lit("}")).alias("json"))


@query("SELECT p_partkey AS seq, CASE WHEN p_partkey % 10 = 0 THEN 'unreadable or of another type' ELSE 'size out of bounds' END AS reason FROM part WHERE p_partkey % 10 = 0 OR p_size > 40")
def upsert_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of another type or out of bounds are refused as a whole."""
    db = Database(spark)
    db.create("p(id id, size int[1,40])")
    return db.put("p", _part_rows(spark, sf_dir)).select("seq", "reason")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS BIGINT) AS size FROM part WHERE p_partkey % 10 <> 0 AND p_size <= 40")
def upsert_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.create("p(id id, size int[1,40])")
    db.put("p", _part_rows(spark, sf_dir))
    return db.frames["p"].select("id", "size")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS BIGINT) AS n FROM customer WHERE c_nationkey < 10")
def upsert_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of closed ids takes rows of ids that another table brought, and no others."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), "c_nationkey", F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"))).alias("json"))
    db = Database(spark)
    db.create("known(id id, n int)")
    db.put("known", c.filter("c_nationkey < 10"))
    db.create(declare("closed(id id, n int)", closed_ids=True))
    db.put("closed", c)
    return db.frames["closed"].select("id", "n")


@query("SELECT p_partkey AS id, p_brand FROM part WHERE p_size < 25")
def save_load_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One saved table takes the place of the table of its name; the others stay."""
    db, path = database(spark, sf_dir, "part", "orders"), _scratch(spark)
    db.frames["part"] = db.frames["part"].filter("p_size < 25")
    db.save(path, ["part"])
    other = database(spark, sf_dir, "part", "orders")
    other.load(path)
    return other.frames["part"].select("id", "p_brand")


@dataclasses.dataclass
class Choice:
    """Which orders are wanted."""

    status: str = "O"
    least: float = 0.0
    priorities: list[str] = dataclasses.field(default_factory=list)


def _chosen(spark: SparkSession, sf_dir: str, c: Choice) -> DataFrame:
    o = read(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == c.status) & (F.col("o_totalprice") >= c.least))
    return (o.filter(F.col("o_orderpriority").isin(c.priorities)) if c.priorities else o).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 150000.5")
def config_toml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a TOML text; a member of another type keeps its default."""
    return _chosen(spark, sf_dir, config.from_toml('status = "F"\nleast = 150000.5\npriorities = "urgent"\n', Choice))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def config_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a YAML text; a member without a value keeps its default."""
    return _chosen(spark, sf_dir, config.from_yaml("status:\npriorities: [1-URGENT, 2-HIGH]\n", Choice))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 7")
def config_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members whose names are not those of the fields."""
    return _chosen(spark, sf_dir, config.from_json('{"if": "P", "from": 7}', Choice, {"if": "status", "from": "least"}))


_CUSTOMER_LINE = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def _customer_lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder of customers as JSON lines, where every seventh line is cut short and is followed by nothing."""
    path = _scratch(spark)
    line = F.to_json(F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")))
    read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 7 == 0, F.lit('{"k": ')).otherwise(line).alias("value")).write.text(path)
    return path


@query("SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 7 <> 0")
def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines as they come; unreadable ones are left out."""
    path = _scratch(spark)
    lines = ingest.json_line_stream(spark, _customer_lines(spark, sf_dir), _CUSTOMER_LINE)
    ingest.append_batches(lines, f"{path}/applied", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(_CUSTOMER_LINE).parquet(f"{path}/applied").select("k", "v")


@query("SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 7 <> 0")
def builder_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset built by the name of its builder."""
    json_lines.register("customers", _CUSTOMER_LINE, "k")
    return json_lines.builder("customers").batch(spark, _customer_lines(spark, sf_dir))


@query("SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 7 <> 0")
def builder_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    json_lines.register("customers", _CUSTOMER_LINE, "k")
    path = _scratch(spark)
    json_lines.builder("customers").stream(spark, _customer_lines(spark, sf_dir), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(_CUSTOMER_LINE).parquet(f"{path}/rows").select("k", "v")


@query("SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def builder_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a dataset by the keys of JSON probes."""
    b = json_lines.register("customers", _CUSTOMER_LINE, "k")
    probes = read(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.to_json(F.struct(F.col("o_custkey").alias("k"))).alias("value"))
    return b.lookup(b.batch(spark, _customer_lines(spark, sf_dir)), json_lines.parse_lines(probes, T.StructType([T.StructField("k", T.LongType())])))


@query("SELECT doc_id, to_base64(encode(text)) AS code, CAST(octet_length(encode(text)) AS INTEGER) AS n FROM documents")
def base64_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as base64, and the number of bytes that come back."""
    code = json_lines.encoded(F.col("text").cast("binary"))
    return read(spark, sf_dir, "documents").select("doc_id", code.alias("code"), F.octet_length(json_lines.decoded(code)).alias("n"))


@query("SELECT p_partkey AS k, p_brand AS v FROM part WHERE p_size < 20")
def dict_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary written once and opened again."""
    return dictionary.commit(_codebook(spark, sf_dir), _scratch(spark)).select("k", "v")


@query("SELECT count(*) AS n FROM part WHERE p_size < 20")
def dict_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.size(_codebook(spark, sf_dir))


@query(f"SELECT user_id AS k, {_LAST.format('event_type')} AS v FROM events GROUP BY 1")
def dict_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last put of every key."""
    return dictionary.build(read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("v"), _order().alias("seq")), "k", "v", "seq")


@query("SELECT event_id // 100000 AS segment, count(*) AS n, CAST(0 AS BIGINT) AS bad FROM events GROUP BY 1")
def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each segment of a stored log, and those whose checksum does not fit."""
    path = _scratch(spark)
    oplog.append(_log(spark, sf_dir), path, "i")
    stored = spark.read.parquet(path)
    counts = stored.groupBy("segment").agg(F.count("*").alias("n"))
    bad = oplog.broken(stored, "i").groupBy("segment").agg(F.count("*").alias("bad"))
    return counts.join(bad, "segment", "left").select(F.col("segment").cast("long").alias("segment"), "n", F.coalesce("bad", F.lit(0).cast("long")).alias("bad"))


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN -(event_id % 97) ELSE event_id % 97 END) AS DOUBLE) AS state FROM events GROUP BY 1")
def log_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the first entries, with the later ones applied to it."""
    log, path = _log(spark, sf_dir), _scratch(spark)
    oplog.snapshot(oplog.replay(log.filter("i <= 400"), "user_id", "i", "op", "v"), 400, path)
    return oplog.resumed(spark, path, log, "user_id", "i", "op", "v")


@query(
    f"""SELECT tag, user_id, weight FROM (SELECT event_type AS tag, user_id, CAST(count(*) AS FLOAT) AS weight, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id DESC) AS r
    FROM events WHERE user_id % 3 <> 0 GROUP BY 1, 2 HAVING count(*) >= {TAG_EVENTS}) WHERE r <= 7"""
)
def topk_weight_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest users of every tag, of those that a filter allows."""
    entries = users(spark, sf_dir).select("user_id", F.explode("w").alias("tag", "weight"))
    return stats.capped_by_key(entries, "tag", "weight", "user_id", 7, F.col("user_id") % 3 != 0).select("tag", "user_id", "weight")


@query("SELECT user_id AS k FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1 HAVING user_id % 3 = 0 OR user_id % 3 = 1 AND max(ts) + INTERVAL 1 DAY > TIMESTAMP '2024-01-15'")
def kv_expire_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expiries set to a point in time: later for a third of the keys, earlier for another."""
    now = F.lit("2024-01-15").cast("timestamp")
    writes = read(spark, sf_dir, "events").filter(F.col("ts") <= now).select(F.col("user_id").alias("k"), keyed.expiry(F.col("ts"), 86_400).alias("expire_at"))
    entries = keyed.expire_at(keyed.rearmed(writes, ["k"]), F.col("k") % 3 == 0, F.lit("2024-02-01"))
    return keyed.alive(keyed.expire_at(entries, F.col("k") % 3 == 2, F.lit("2024-01-14")), now).select("k")


@query("SELECT event_type AS pool, count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY 1")
def kv_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of each pool."""
    writes = read(spark, sf_dir, "events").select(F.col("event_type").alias("pool"), F.col("user_id").alias("k"), F.col("event_id").alias("seq"))
    return keyed.pools(keyed.state(writes, ["pool", "k"]), "pool")


@query(
    f"""SELECT pool, k, v FROM (SELECT event_type AS pool, user_id AS k, {_LAST.format('event_id')} AS v, max(ts) + INTERVAL 1 DAY AS x FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1, 2)
    WHERE x > TIMESTAMP '2024-01-15 08:00:00'"""
)
def kv_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store saved at one time and loaded eight hours later, without what expired by then."""
    e, path = read(spark, sf_dir, "events").filter(F.col("ts") <= F.lit("2024-01-15").cast("timestamp")), _scratch(spark)
    writes = e.select(F.col("event_type").alias("pool"), F.col("user_id").alias("k"), F.col("event_id").alias("v"), keyed.expiry(F.col("ts"), 86_400).alias("expire_at"), _order().alias("seq"))
    entries = keyed.state(writes, ["pool", "k"]).select("pool", "k", "v", "expire_at")
    keyed.save(entries, path, F.lit("2024-01-15").cast("timestamp"), "pool")
    return keyed.load(spark, path, entries.schema, F.lit("2024-01-15 08:00:00").cast("timestamp")).select("pool", "k", "v")


@query("SELECT CAST(n AS INTEGER) AS size, n BETWEEN 1 AND 256 AND n % 8 = 0 AS allowed FROM range(0, 300, 4) r(n)")
def kv_field_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sizes a field may have."""
    return spark.createDataFrame([(n, _error(keyed.check_field_size, n) is None) for n in range(0, 300, 4)], "size int, allowed boolean")


@query("SELECT user_id AS key, f AS field, lpad(hex(f), 16, '0') AS image FROM (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN event_id ELSE -event_id END AS f FROM events)")
def omap_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered maps in the order of their fields' bytes, so negative numbers come last, with these bytes."""
    field = F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(-F.col("event_id"))
    rows = keyed.ordered(read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), field.alias("field")), "key", "field")
    return rows.select("key", "field", F.hex(keyed.unsigned_order(F.col("field"))).alias("image"))


def _batches(spark: SparkSession, path: str, stream: DataFrame) -> None:
    """Runs a stream of closed windows to its end."""
    ingest.append_batches(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS span FROM g)
    SELECT user_id AS k, min(ts) AS born, max(ts) + INTERVAL 12 HOUR AS expires, count(*) AS writes FROM s GROUP BY user_id, span"""
)
def stream_live_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From when to when every key of a stream lived; a row far ahead closes all spans."""
    source, path = _scratch(spark), _scratch(spark)
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("ts"))
    e.union(spark.sql("SELECT -1L AS k, TIMESTAMP '2200-01-01 00:00:00' AS ts")).write.parquet(source)
    _batches(spark, path, ingest.live_spans(spark.readStream.schema(e.schema).parquet(source), "ts", "k", "12 hours", "1 hour"))
    spans = spark.read.parquet(f"{path}/out").filter("k >= 0")
    return spans.select("k", F.col("born").cast("timestamp_ntz").alias("born"), F.col("expires").cast("timestamp_ntz").alias("expires"), "writes")


@query("SELECT user_id AS k, arg_max(event_type, ts) AS v FROM events GROUP BY 1")
def stream_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a stream from its compacted batches."""
    target = _scratch(spark)
    ingest.compact(spark, _streamed(spark, sf_dir), target, ["k"], "seq", _WRITES)
    return ingest.upsert_state(spark, target, ["k"], "seq", _WRITES).select("k", "v")


def _error(f: Callable, *args) -> int | None:
    """The code of the error that a call raises, None for none."""
    try:
        f(*args)
    except EngineError as e:
        return e.code
    return None


_TEXTS = (
    ("expression", "item.vv + 1", None), ("expression", "item.vv + 1 rest", 10001), ("expression", "(item.vv", 10001), ("expression", "nope(1)", 10003), ("expression", "one(nope(1))", 10003),
    ("expression", "item.nope", 10004), ("expression", "$unset", 10004), ("expression", "item.vv + item.id", 10006), ("expression", "one(1, 2)", 10007),
    ("query", "part.p_size == 3", None), ("query", "part.p_size == 3 )", 10001), ("query", "part.size == 3", 10004), ("query", "other.p_size == 3", 10004), ("query", "part.p_size == f(3)", 10003),
    ("query", "part.p_size == $three", 10003), ("query", "part.p_brand < 3", 10006),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}', CAST({'NULL' if c is None else c} AS INTEGER))" for k, t, c in _TEXTS) + ") v(kind, text, code)")
def language_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of each text, found before any row is read: expressions over records, queries over a table."""
    c, db = Compiler(records(spark, sf_dir).schema, _FUNCTIONS), database(spark, sf_dir, "part")
    return spark.createDataFrame([(k, t, _error(c.compile if k == "expression" else db.compile, t)) for k, t, _ in _TEXTS], "kind string, text string, code int")


@query("SELECT p_partkey AS key, CASE WHEN p_size > 25 THEN CAST(p_size + 1 AS BIGINT) END AS a, CASE WHEN p_size > 25 THEN p_size > 30 END AS b FROM part")
def expr_null_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing record on the way to a member makes the expression null."""
    df = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.struct(F.when(F.col("p_size") > 25, F.struct(F.col("p_size").alias("vv"))).alias("sub")).alias("item"))
    c = Compiler(df.schema)
    return df.select("key", c.compile("item.sub.vv+1").alias("a"), c.compile("item.sub.vv>30").alias("b"))


@query("SELECT p_partkey AS key, CAST(p_size * 2 + 2 AS BIGINT) AS a, p_size > 7 AND p_brand = 'Brand#11' AS b FROM part")
def expr_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps, arrays and records go to functions whole."""
    df = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), F.create_map(F.lit("size"), F.col("p_size")).alias("sizes"), F.array("p_brand", "p_type").alias("words"), F.struct(F.col("p_size").alias("n")).alias("whole")
    )
    functions = {
        "at_size": Function(lambda m: m["size"].cast("long"), "int", 1),
        "length": Function(lambda a: F.size(a).cast("long"), "int", 1),
        "has": Function(lambda a, w: F.array_contains(a, w), "bool", 2),
        "large": Function(lambda r: r["n"] > 7, "bool", 1),
    }
    c = Compiler(df.schema, functions)
    return df.select("key", c.compile("at_size(sizes)*2+length(words)").alias("a"), c.compile('large(whole) && has(words, "Brand#11")').alias("b"))


@query("SELECT p_partkey AS key, CAST(p_size * 2 - p_partkey AS BIGINT) AS a FROM part")
def expr_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that begin as literals do."""
    df = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("truest"), F.struct(F.col("p_partkey").alias("_n1")).alias("falsehood"))
    return df.select("key", Compiler(df.schema).compile("truest*2-falsehood._n1").alias("a"))


def _flows() -> Manager:
    m = Manager(OPS)
    m.load(FLOWS, "flows")
    return m


@OPS.op("above", least=300000.0)
def dear_orders(orders: DataFrame, params) -> DataFrame:
    return orders.filter(F.col("o_totalprice") > params["least"])


@OPS.op("held")
def held_orders(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("o_orderstatus").isin(OPS.get("words", "open")))


OPS.resource("words", "open", lambda: ["O", "P"])

MORE_FLOWS = """
strict_dsl = false
[[config_setting]]
name = "strict_prices"
cond = '$mode=="strict"'
[[graph]]
name = "chosen"
priority = 1
[[graph.vertex]]
processor = "big_orders"
args = { least = 100000 }
[[graph]]
name = "chosen"
priority = 3
expect_version = "2"
[[graph.vertex]]
processor = "big_orders"
args = { least = 200000 }
[[graph]]
name = "chosen"
priority = 2
[[graph.vertex]]
processor = "big_orders"
args = { least = 300000 }
[[graph]]
name = "inherited"
[[graph.vertex]]
processor = "big_orders"
[[graph]]
name = "masked"
[[graph.vertex]]
processor = "failing"
successor_on_ok = ["big_orders"]
successor_on_err = ["small_orders"]
[[graph.vertex]]
processor = "big_orders"
args = { least = 100000 }
[[graph.vertex]]
processor = "small_orders"
args = { least = 100000 }
[[graph]]
name = "renamed"
[[graph.vertex]]
processor = "big_orders"
input = [{ field = "orders", id = "$source", extern = true, required = true }]
args = { least = 100000 }
[[graph]]
name = "moved"
[[graph.vertex]]
processor = "big_orders"
args = { least = 100000 }
[[graph.vertex]]
id = "first"
processor = "by_status"
input = [{ field = "rows", id = "big", move = true }]
[[graph.vertex]]
id = "second"
processor = "small_orders"
input = [{ field = "orders", id = "big", required = true }]
deps = ["first"]
args = { least = 1 }
[[graph]]
name = "held"
[[graph.vertex]]
processor = "held_orders"
start = true
[[graph]]
name = "gated"
[[graph.vertex]]
processor = "big_orders"
expect_config = "strict_prices"
args = { least = 100000 }
"""


def _more_flow(name: str, graph: str, out: str, sql: str, data: tuple[str, ...] = ("orders",), version: str | None = None, **params) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = Manager(OPS)
        m.load(MORE_FLOWS, "more", version)
        return m.run("more", graph, dict.fromkeys(data, read(spark, sf_dir, "orders")), params)[out]

    run.__name__, run.__doc__ = name, f"Datum {out} of graph {graph}."
    query(sql)(run)


_DEARER = "SELECT * FROM orders WHERE o_totalprice > {}"
_more_flow("flow_priority", "chosen", "big", _DEARER.format(200000), version="2")
_more_flow("flow_version", "chosen", "big", _DEARER.format(300000), version="1")
_more_flow("flow_params_chain", "inherited", "big", _DEARER.format(250000), least=250000)
_more_flow("flow_error_masked", "masked", "big", _DEARER.format(100000))
_more_flow("flow_dynamic_name", "renamed", "big", _DEARER.format(100000), data=("elsewhere",), source="elsewhere")
_more_flow("flow_moved", "moved", "counts", _COUNTS)
_more_flow("flow_resource", "held", "held", "SELECT * FROM orders WHERE o_orderstatus IN ('O', 'P')")
_more_flow("flow_params_text", "gated", "big", _DEARER.format(100000), **params_of_text("mode=strict,unused=true"))


@query(_DEARER.format(300000))
def flow_default_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One operation on its own, with its declared parameters."""
    return Manager(OPS).run_op("dear_orders", {"orders": read(spark, sf_dir, "orders")})["above"]


@query(_DEARER.format(50000))
def flow_single_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Manager(OPS).run_op("dear_orders", {"orders": read(spark, sf_dir, "orders")}, {"least": 50000})["above"]


@query("SELECT * FROM (VALUES ('failed', 'failing', 'err'), ('failed', 'big_orders', 'skip'), ('failed', 'small_orders', 'ok'), ('failed', 'tagged', 'ok'), ('moved', 'big_orders', 'ok'), ('moved', 'first', 'ok'), ('moved', 'second', 'err'), ('late', 'big_orders', 'skip'), ('late', 'by_status', 'skip')) v(run, vertex, result)")
def flow_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every vertex: a run with an error, one whose datum was moved away, and one that is late from its start."""
    m, orders = _flows(), {"orders": read(spark, sf_dir, "orders")}
    m.load(MORE_FLOWS, "more")
    runs = {"failed": m.run("flows", "failed", orders), "moved": m.run("more", "moved", orders), "late": m.run("flows", "linear", orders, timeout=-1)}
    return spark.createDataFrame([(name, v, r) for name, done in runs.items() for v, r in done.results.items()], "run string, vertex string, result string")


@query("SELECT * FROM (VALUES (0, 'big_orders', 'orders', 'big'), (1, 'by_status', 'rows', 'counts')) v(place, vertex, inputs, outputs)")
def flow_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices of a graph in order: their ids are those of their operations, their data those of the arguments."""
    g = _flows().clusters["flows"].graphs["linear"]
    names = lambda data: ",".join(d.field for d in data)
    return spark.createDataFrame([(n, i, names(g.vertices[i].input), names(g.vertices[i].output)) for n, i in enumerate(g.order())], "place int, vertex string, inputs string, outputs string")


_VERTEX = "[[graph.vertex]]\n{}\n"
_REFUSED = (
    ("cycle", 'id="a"\nprocessor="big_orders"\ndeps=["b"]', 'id="b"\nprocessor="small_orders"\ndeps=["a"]'),
    ("two vertices of one id", 'id="a"\nprocessor="big_orders"\nstart=true', 'id="a"\nprocessor="small_orders"\nstart=true'),
    ("two producers of one datum", 'id="a"\nprocessor="big_orders"\nstart=true', 'id="b"\nprocessor="big_orders"\nstart=true'),
    ("a vertex alone", 'processor="big_orders"', 'processor="small_orders"'),
    ("a start after another", 'processor="big_orders"\nsuccessor=["small_orders"]', 'processor="small_orders"\nstart=true'),
    ("a date as argument", 'processor="big_orders"\nargs={least=2024-01-01}'),
    ("an unknown vertex", 'processor="big_orders"\ndeps=["none"]'),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', 20001)" for c, *_ in _REFUSED) + ", ('none', NULL)) v(fault, code)")
def flow_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of graphs that cannot be built, and none of one that can."""
    text = lambda vertices: 'strict_dsl = false\n[[graph]]\nname = "g"\n' + "".join(map(_VERTEX.format, vertices))
    cases = (*_REFUSED, ("none", 'processor="big_orders"\nargs={least=1, many=[1, 2], more={x="y"}}'))
    return spark.createDataFrame([(c, _error(Manager(OPS).load, text(v), c)) for c, *v in cases], "fault string, code int")


@query("SELECT * FROM (VALUES ('linear', true), ('none', false)) v(graph, found)")
def flow_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _flows()
    return spark.createDataFrame([(g, m.exists("flows", g)) for g in ("linear", "none")], "graph string, found boolean")


@query("SELECT * FROM (VALUES ('big_orders', 'orders', 'big', '{}'), ('by_status', 'rows', 'counts', '{}'), ('dear_orders', 'orders', 'above', '{\"least\": 300000.0}')) v(name, inputs, outputs, params)")
def flow_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the registry tells of some operations."""
    told = [d for d in OPS.describe() if d["name"] in ("big_orders", "by_status", "dear_orders")]
    return spark.createDataFrame([(d["name"], ",".join(d["inputs"]), ",".join(d["outputs"]), json.dumps(d["params"])) for d in told], "name string, inputs string, outputs string, params string")


@query("SELECT * FROM (VALUES ('diamond', 1), ('box', 3), ('Msquare', 2), ('box3d', 0), ('dashed', 2), ('bold', 2)) v(style, n)")
def flow_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges by style in the picture of a graph with a branch."""
    dot = _flows().clusters["flows"].graphs["branch"].dot()
    counts = [(s, len(re.findall(rf"=(?:{s})\b", dot))) for s in ("diamond", "box", "Msquare", "box3d", "dashed", "bold")]
    return spark.createDataFrame(counts, "style string, n int")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a conjunction of an exclusive word and a number."""
    return page(database(spark, sf_dir, "orders").select('orders.o_orderstatus=="F" && orders.o_totalprice>100000').matched)


