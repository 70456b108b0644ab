"""Queries over the star-schema tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import documents
from .operators import find, tree, writes
from .operators.lookup import Lookup, lookup, lookup_all
from .sources.scratch import settled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
CLOCK = dt.datetime(2024, 1, 2, 3, 4, 5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def filtered(name: str, source: str, filter_: dict[str, Any], columns: list[str], where: str, derive: Callable[[DataFrame], DataFrame] | None = None, from_: str | None = None) -> None:
    """A query that projects some columns of a table's matching rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return find.find_many(derive(df) if derive else df, filter_, projection=columns)

    query(name, f"SELECT {', '.join(columns)} FROM {from_ or source} WHERE {where}")(run)


# --- F: filters

ORDER = ["o_orderkey", "o_orderstatus", "o_totalprice"]
filtered("filter_all", "nation", {}, ["n_nationkey", "n_name"], "true")
filtered("filter_eq_range", "orders", {"o_orderstatus": "F", "o_totalprice": {"$gt": 400000}}, ORDER, "o_orderstatus = 'F' AND o_totalprice > 400000")
filtered("filter_range_pair", "orders", {"o_totalprice": {"$gte": 100000, "$lt": 120000}}, ORDER, "o_totalprice >= 100000 AND o_totalprice < 120000")
filtered("filter_lte", "customer", {"c_acctbal": {"$lte": 0}}, ["c_custkey", "c_acctbal"], "c_acctbal <= 0")
filtered("filter_date_range", "orders", {"o_orderdate": {"$gte": dt.datetime(1995, 1, 1), "$lt": dt.datetime(1995, 3, 1)}}, ["o_orderkey", "o_orderdate"], "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-03-01'")
filtered("filter_type_strict", "orders", {"$or": [{"o_totalprice": "400000"}, {"o_orderkey": {"$lt": 100}}]}, ORDER, "o_orderkey < 100")
filtered("filter_ne_nin", "customer", {"c_mktsegment": {"$ne": "BUILDING", "$nin": ["MACHINERY"]}, "c_nationkey": {"$in": [1, 2, 3]}}, ["c_custkey", "c_mktsegment"], "c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)")
filtered("filter_in_empty", "customer", {"$or": [{"c_nationkey": {"$in": []}}, {"$and": [{"c_nationkey": {"$nin": []}}, {"c_custkey": {"$lt": 20}}]}]}, ["c_custkey"], "c_custkey < 20")
filtered("filter_or", "lineitem", {"$or": [{"l_quantity": {"$gt": 49}}, {"l_returnflag": "R", "l_discount": {"$gte": 0.1}}]}, ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"], "l_quantity > 49 OR (l_returnflag = 'R' AND l_discount >= 0.1)")
filtered("filter_logic_nor", "lineitem", {"$nor": [{"l_returnflag": "R"}, {"l_quantity": {"$gt": 5}}]}, ["l_orderkey", "l_linenumber", "l_quantity"], "NOT (l_returnflag = 'R' OR l_quantity > 5)")
filtered("filter_not_top", "orders", {"$not": {"o_orderstatus": "O", "o_totalprice": {"$lt": 450000}}}, ORDER, "NOT (o_orderstatus = 'O' AND o_totalprice < 450000)")
filtered("filter_not_field", "supplier", {"s_acctbal": {"$not": {"$gt": 500, "$lt": 9000}}}, ["s_suppkey", "s_acctbal"], "NOT (s_acctbal > 500 AND s_acctbal < 9000)")
filtered("filter_regex", "part", {"p_type": {"$regex": "(?i)^(STANDARD|promo).*"}}, ["p_partkey", "p_type"], "regexp_matches(p_type, '(?i)^(STANDARD|promo).*')")
filtered("filter_like", "part", {"p_name": {"$like": "%re%"}, "p_brand": {"$not": {"$like": "Brand#1%"}}}, ["p_partkey", "p_name"], "p_name LIKE '%re%' AND NOT p_brand LIKE 'Brand#1%'")
NULLABLE = "(SELECT *, nullif(o_orderstatus, 'P') AS status FROM orders)"
_status = lambda df: df.withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P")))
filtered("filter_null", "orders", {"status": None}, ["o_orderkey"], "status IS NULL", _status, NULLABLE)
filtered("filter_ne_matches_missing", "orders", {"status": {"$ne": "F"}}, ["o_orderkey", "status"], "status <> 'F' OR status IS NULL", _status, NULLABLE)
filtered("filter_exists", "orders", {"status": {"$exists": True}, "nothing": {"$exists": False}}, ["o_orderkey", "status"], "status IS NOT NULL", _status, NULLABLE)
filtered("filter_in_null", "orders", {"status": {"$in": [None, "F"]}}, ["o_orderkey", "status"], "status IS NULL OR status = 'F'", _status, NULLABLE)
filtered("filter_nin_null", "orders", {"status": {"$nin": [None, "F"]}}, ["o_orderkey", "status"], "status IS NOT NULL AND status <> 'F'", _status, NULLABLE)
filtered("filter_not_range_null", "orders", {"$nor": [{"status": {"$gte": "G"}}]}, ["o_orderkey", "status"], "status < 'G' OR status IS NULL", _status, NULLABLE)
TAGGED = "(SELECT *, string_split(p_name, ' ') AS tags FROM part)"
_tags = lambda df: df.withColumn("tags", F.split("p_name", " "))
PART = ["p_partkey", "p_name"]
filtered("filter_array_contains", "part", {"tags": "red"}, PART, "list_contains(tags, 'red')", _tags, TAGGED)
filtered("filter_array_exact", "part", {"tags": ["red", "widget"]}, PART, "tags = ['red', 'widget']", _tags, TAGGED)
filtered("filter_array_all", "part", {"tags": {"$all": ["red", "widget"]}}, PART, "list_contains(tags, 'red') AND list_contains(tags, 'widget')", _tags, TAGGED)
filtered("filter_array_size", "part", {"tags": {"$size": {"$gte": 2}}}, PART, "len(tags) >= 2", _tags, TAGGED)
filtered("filter_array_elem", "part", {"tags": {"$elemMatch": {"$gt": "r", "$lt": "s"}}}, PART, "len(list_filter(tags, lambda x: x > 'r' AND x < 's')) > 0", _tags, TAGGED)
filtered("filter_array_ne", "part", {"tags": {"$ne": "red"}}, PART, "NOT list_contains(tags, 'red')", _tags, TAGGED)
filtered("filter_array_in_regex", "part", {"tags": {"$in": ["red", "blue"], "$regex": "^w"}}, PART, "(list_contains(tags, 'red') OR list_contains(tags, 'blue')) AND len(list_filter(tags, lambda x: regexp_matches(x, '^w'))) > 0", _tags, TAGGED)
filtered("filter_array_range", "embeddings", {"embedding": {"$gt": 0.4}}, ["vec_id", "label"], "len(list_filter(embedding, lambda x: x > 0.4)) > 0")
filtered("filter_array_index", "embeddings", {"embedding.0": {"$lt": 0}, "embedding.63": {"$gte": 0}}, ["vec_id"], "embedding[1] < 0 AND embedding[64] >= 0")
_nested = lambda df: df.withColumn("info", F.struct(F.struct(F.col("c_nationkey").alias("code")).alias("nation"), F.col("c_mktsegment").alias("segment")))
filtered("filter_nested_path", "customer", {"info.nation.code": {"$gte": 20}, "info.segment": "MACHINERY", "info.none.such": None}, ["c_custkey"], "c_nationkey >= 20 AND c_mktsegment = 'MACHINERY'", _nested)
filtered("filter_object_equal", "customer", {"info": {"segment": "BUILDING", "nation": {"code": 7}}}, ["c_custkey"], "c_nationkey = 7 AND c_mktsegment = 'BUILDING'", _nested)
filtered("filter_variant_path", "events", {"doc.k": {"$gt": 90}}, ["event_id"], "CAST(json_extract(props, '$.k') AS DOUBLE) > 90", lambda df: df.withColumn("doc", F.parse_json("props")))
filtered("filter_id_text", "customer", {"id": {"$in": [1, 2, "3"]}}, ["id"], "id IN ('1', '2', '3')", lambda df: df.withColumn("id", F.col("c_custkey").cast("string")), "(SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer)")


@query("filter_fan_out", "SELECT c_custkey FROM (SELECT o_custkey AS c_custkey, max(o_totalprice) AS m, bool_or(o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1) WHERE m > 490000 AND u")
def filter_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))).alias("orders"))
    return find.find_many(lists, {"orders.price": {"$gt": 490000}, "orders.priority": "1-URGENT"}, projection=["c_custkey"])


@query("filter_elem_document", "SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 480000 AND o_orderstatus = 'F'")
def filter_elem_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct("o_totalprice", "o_orderstatus")).alias("orders"))
    return find.find_many(lists, {"orders": {"$elemMatch": {"o_totalprice": {"$gt": 480000}, "o_orderstatus": "F"}}}, projection=["c_custkey"])


@query("filter_dynamic", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) > 90 AND event_type IN ('click', 'view')")
def filter_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.from_json("props", "k double").alias("props"))).alias("data"))
    return documents.filter_documents(docs, {"props.k": {"$gt": 90}, "type": {"$in": ["click", "view"]}}).select("event_id")


# --- Q: find, sort, project, page


@query("flagship", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find_many(table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_totalprice": {"$gt": 400000}}, sort={"o_totalprice": -1, "o_orderkey": 1}, limit=10, projection=["o_orderkey", "o_totalprice", "o_orderdate"])


@query("find_sort_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice, o_orderkey LIMIT 21 OFFSET 40")
def find_sort_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.page_frame(table(spark, sf_dir, "orders"), {"o_orderstatus": "O"}, page_index=3, page_size=20, sort=["o_totalprice", "o_orderkey"], projection={"o_orderkey": 1, "o_totalprice": 1})


@query("find_nulls_first", f"SELECT o_orderkey, status FROM {NULLABLE} ORDER BY status ASC NULLS FIRST, o_orderkey DESC LIMIT 50")
def find_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find_many(_status(table(spark, sf_dir, "orders")), {}, sort=["status", "-o_orderkey"], limit=50, projection=["o_orderkey", "status"])


@query("find_offset_only", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100")
def find_offset_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find_many(table(spark, sf_dir, "customer"), {}, sort=["c_custkey"], offset=100, limit=0, projection=["c_custkey"])


@query("find_one", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")
def find_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find_one(table(spark, sf_dir, "supplier"), {}, sort={"s_acctbal": -1, "s_suppkey": 1}, projection=["s_suppkey", "s_acctbal"])


@query("find_case_insensitive", "SELECT n_nationkey, n_name FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS n_name FROM nation) ORDER BY lower(n_name), n_nationkey LIMIT 10")
def find_case_insensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = table(spark, sf_dir, "nation").withColumn("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    return find.find_many(mixed, {}, sort=["n_name", "n_nationkey"], case_sensitive=False, limit=10, projection=["n_nationkey", "n_name"])


@query("find_numeric_order", "SELECT p_partkey, tag FROM (SELECT p_partkey, 'p' || CAST(p_size AS VARCHAR) AS tag, p_size FROM part) ORDER BY p_size, p_partkey LIMIT 40")
def find_numeric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").withColumn("tag", F.concat(F.lit("p"), F.col("p_size").cast("string")))
    return find.find_many(df, {}, sort=["tag", "p_partkey"], numeric_ordering=True, limit=40, projection=["p_partkey", "tag"])


@query("find_exclude", "SELECT c_custkey, c_name FROM customer")
def find_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find_many(table(spark, sf_dir, "customer"), {}, projection={"c_nationkey": 0, "c_acctbal": -1, "c_mktsegment": False})


@query("find_dotted_projection", "SELECT c_custkey, c_nationkey AS code FROM customer")
def find_dotted_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = find.find_many(_nested(table(spark, sf_dir, "customer")), {}, projection=["c_custkey", "info.nation.code"])
    return cut.select("c_custkey", F.col("info.nation.code").alias("code"))


@query("count_filter", "SELECT count(*) AS count FROM events WHERE event_type = 'purchase' AND value > 50")
def count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.count(table(spark, sf_dir, "events"), {"event_type": "purchase", "value": {"$gt": 50}})


@query("find_cursor_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 1000 ORDER BY o_orderkey LIMIT 26")
def find_cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = find.cursor_frame(table(spark, sf_dir, "orders"), {"o_orderstatus": "F"}, cursor=1000, sort_key="o_orderkey", page_size=25, projection=["o_orderkey", "o_totalprice"])
    return page.drop("__key")


@query("find_cursor_ties", "SELECT c_custkey FROM customer WHERE c_nationkey < 10 OR (c_nationkey = 10 AND c_custkey > 50) ORDER BY c_nationkey DESC, c_custkey LIMIT 31")
def find_cursor_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("_id", F.col("c_custkey"))
    return find.cursor_frame(rows, {}, cursor=(10, 50), sort_key="c_nationkey", descending=True, page_size=30, projection=["c_custkey"]).select("c_custkey")


@query("find_get_by_id", "SELECT id, c_name FROM (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name FROM customer) WHERE id = '42'")
def find_get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.get(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_name"), 42)


@query("find_by_ids", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def find_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = find.find_many(table(spark, sf_dir, "customer"), {"c_acctbal": {"$lt": 0}}, projection=["c_custkey"])
    return find.by_ids(table(spark, sf_dir, "orders"), poor, "o_custkey").select("o_orderkey", "o_custkey")


# --- J: lookup joins


@query("lookup_one", "SELECT o_orderkey, c_name, c_acctbal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def lookup_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = find.find_many(table(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING"})
    return lookup(table(spark, sf_dir, "orders"), Lookup(some, "o_custkey", "c_custkey", "customer")).select("o_orderkey", "customer.c_name", "customer.c_acctbal")


@query("lookup_many", "SELECT o_custkey AS c_custkey, string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS found, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def lookup_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    keyed = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    joined = lookup(keyed, Lookup(find.find_many(orders, {"o_orderstatus": "F"}), "keys", "o_orderkey", "docs", ["o_orderpriority"]))
    return joined.where(F.size("docs") > 0).select("c_custkey", F.array_join("docs.o_orderpriority", "|").alias("found"), F.size("docs").cast("long").alias("n"))


@query("lookup_last_wins", "SELECT c_custkey, last_key, o_totalprice AS last_price FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_key, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def lookup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("_id", F.col("o_orderkey"))
    found = lookup(table(spark, sf_dir, "customer"), Lookup(orders, "c_custkey", "o_custkey", "last", ["o_orderkey", "o_totalprice"]))
    return found.select("c_custkey", F.col("last.o_orderkey").alias("last_key"), F.col("last.o_totalprice").alias("last_price"))


@query("lookup_several", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON s_nationkey = r_regionkey")
def lookup_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    joins = [Lookup(table(spark, sf_dir, "nation"), "s_nationkey", "n_nationkey", "nation"), Lookup(table(spark, sf_dir, "region"), "s_nationkey", "r_regionkey", "region")]
    return lookup_all(table(spark, sf_dir, "supplier"), joins).select("s_suppkey", "nation.n_name", "region.r_name")


@query("lookup_null_key", f"SELECT o_orderkey, CASE WHEN status = 'F' THEN 'done' END AS word FROM {NULLABLE}")
def lookup_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([("F", "done")], "code string, word string")
    return lookup(_status(table(spark, sf_dir, "orders")), Lookup(words, "status", "code", "meaning")).select("o_orderkey", "meaning.word")


@query("lookup_hidden_target", "SELECT s_suppkey, CASE WHEN n_regionkey <> 1 THEN n_name END AS n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def lookup_hidden_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").withColumn("_isDeleted", F.col("n_regionkey") == 1)
    return lookup(table(spark, sf_dir, "supplier"), Lookup(nations, "s_nationkey", "n_nationkey", "nation", hide_deleted=True)).select("s_suppkey", "nation.n_name")


@query("lookup_page", "SELECT o_orderkey, c_name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) JOIN customer ON o_custkey = c_custkey")
def lookup_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = find.find_many(table(spark, sf_dir, "orders"), {}, sort={"o_totalprice": -1, "o_orderkey": 1}, limit=20)
    return lookup(page, Lookup(table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", "customer"), bounded=True).select("o_orderkey", "customer.c_name")


# --- U: updates


@query("update_inc_mul_min_max", "SELECT p_partkey, CASE WHEN hit THEN p_size + 10 ELSE p_size END AS p_size, CASE WHEN hit THEN least(p_retailprice * 2, 1500.0) ELSE p_retailprice END AS p_retailprice, CASE WHEN hit THEN greatest(p_name, 'm') ELSE p_name END AS p_name FROM (SELECT *, p_size > 25 AS hit FROM part)")
def update_inc_mul_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = {"$inc": {"p_size": 10}, "$mul": {"p_retailprice": 2}, "$min": {"p_retailprice": 1500.0}, "$max": {"p_name": "m"}}
    return writes.update_many(table(spark, sf_dir, "part"), {"p_size": {"$gt": 25}}, op).select("p_partkey", "p_size", "p_retailprice", "p_name")


@query("update_set_nested", "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'X' ELSE c_mktsegment END AS segment, CASE WHEN c_nationkey < 5 THEN 99 ELSE c_nationkey END AS code, CASE WHEN c_nationkey < 5 THEN 1::BIGINT ELSE 0 END AS level FROM customer")
def update_set_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = writes.update_many(_nested(table(spark, sf_dir, "customer")), {"c_nationkey": {"$lt": 5}}, {"$set": {"info.segment": "X", "info.nation.code": 99, "info.nation.level": 1}})
    return out.select("c_custkey", F.col("info.segment").alias("segment"), F.col("info.nation.code").alias("code"), F.coalesce("info.nation.level", F.lit(0)).alias("level"))


@query("update_rename_unset", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_name END AS s_name, CASE WHEN s_acctbal < 0 THEN s_name END AS label, CASE WHEN s_acctbal < 0 THEN -1 ELSE s_nationkey END AS s_nationkey FROM supplier")
def update_rename_unset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.update_many(table(spark, sf_dir, "supplier"), {"s_acctbal": {"$lt": 0}}, {"$rename": {"s_name": "label"}, "$unset": ["s_nationkey"]}).select("s_suppkey", "s_name", "label", F.coalesce("s_nationkey", F.lit(-1)).alias("s_nationkey"))


def _pushed(name: str, op: dict[str, Any], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = writes.update_many(_tags(table(spark, sf_dir, "part")), {"p_size": {"$gt": 10}}, op)
        return out.select("p_partkey", F.array_join("tags", ",").alias("tags"))

    query(name, f"SELECT p_partkey, array_to_string(CASE WHEN p_size > 10 THEN {sql} ELSE tags END, ',') AS tags FROM {TAGGED}")(run)


_pushed("update_push", {"$push": {"tags": "new"}}, "list_append(tags, 'new')")
_pushed("update_push_each_slice", {"$push": {"tags": {"$each": ["a", "b"], "$slice": -3}}}, "list_concat(tags, ['a', 'b'])[-3:]")
_pushed("update_push_position", {"$push": {"tags": {"$each": ["a", "b"], "$position": 1}}}, "list_concat(list_concat(tags[1:1], ['a', 'b']), tags[2:])")
_pushed("update_add_to_set", {"$addToSet": {"tags": {"$each": ["red", "new", "new"]}}}, "list_concat(list_concat(tags, CASE WHEN list_contains(tags, 'red') THEN [] ELSE ['red'] END), CASE WHEN list_contains(tags, 'new') THEN [] ELSE ['new'] END)")
_pushed("update_pop_last", {"$pop": {"tags": 1}}, "tags[1:len(tags) - 1]")
_pushed("update_pop_first", {"$pop": {"tags": -1}}, "tags[2:]")
_pushed("update_pull", {"$pull": {"tags": {"$in": ["red", "widget"]}}}, "list_filter(tags, lambda x: x NOT IN ('red', 'widget'))")
_pushed("update_pull_operator", {"$pull": {"tags": {"$gte": "m"}}}, "list_filter(tags, lambda x: x < 'm')")


@query("update_one_sorted", "SELECT c_custkey, CASE WHEN c_custkey = (SELECT c_custkey FROM customer WHERE c_nationkey = 3 ORDER BY c_acctbal DESC, c_custkey LIMIT 1) THEN 'TOP' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_one_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey").cast("string"))
    return writes.update_one(people, {"c_nationkey": 3}, {"$set": {"c_mktsegment": "TOP"}}, sort={"c_acctbal": -1, "c_custkey": 1}).select("c_custkey", "c_mktsegment")


@query("update_bulk_by_id", "SELECT id, CASE WHEN id = '5' THEN 'B' WHEN id = '7' THEN 'C' ELSE c_mktsegment END AS c_mktsegment FROM (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment FROM customer)")
def update_bulk_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = [{"filter": {"id": i}, "update": {"$set": {"c_mktsegment": s}}} for i, s in ((5, "A"), (7, "C"), (5, "B"), (-1, "D"))]
    return writes.bulk_update(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_mktsegment"), items)


@query("update_upsert", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_nationkey AS n, CASE WHEN c_nationkey = 7 THEN 'seen' ELSE c_name END AS word FROM customer UNION ALL SELECT 'x1', 500, 'fresh'")
def update_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").alias("n"), F.col("c_name").alias("word"))
    met = writes.upsert_many(rows, {"n": 7}, {"$set": {"word": "seen"}, "$setOnInsert": {"id": "unused"}})
    return writes.upsert_many(met, {"id": "x1"}, {"$set": {"word": "fresh"}, "$setOnInsert": {"n": 500}})


@query("update_dynamic", "SELECT event_id, CASE WHEN k > 50 THEN k + 1 ELSE k END AS k FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)")
def update_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("data"))
    return documents.update_documents(docs, {"k": {"$gt": 50}}, {"$inc": {"k": 1}}).select("event_id", F.get_json_object("data", "$.k").cast("double").alias("k"))


# --- W: write verbs; all customers are in the table, those with orders come in, and suppliers under new ids

STORED = "(SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal AS bal FROM customer)"
COMING = "(SELECT CAST(c_custkey AS VARCHAR) AS id, 'new' AS name, c_nationkey AS nation FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT CAST(-1 - s_suppkey AS VARCHAR), 'new ' || s_nationkey, s_nationkey FROM supplier)"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))


def _coming(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    known = buyers.select(F.col("c_custkey").cast("string").alias("id"), F.lit("new").alias("name"), F.col("c_nationkey").alias("nation"))
    fresh = table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).cast("string").alias("id"), F.concat(F.lit("new "), F.col("s_nationkey").cast("string")).alias("name"), F.col("s_nationkey").alias("nation"))
    return known.unionByName(fresh)


def _verb(name: str, sql: str, work: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    sql = sql.format(s=STORED, c=COMING)
    filled = "nation" in sql.split(" FROM ")[0]  # an absent number is -1 on both sides
    sql = f"SELECT * REPLACE (coalesce(nation, -1) AS nation) FROM ({sql})" if filled else sql

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = work(_stored(spark, sf_dir), _coming(spark, sf_dir))
        return out.na.fill(-1, ["nation"]) if filled else out

    query(name, sql)(run)


_verb("insert_skip_existing", "SELECT id, name, bal, NULL::INT AS nation FROM {s} UNION ALL SELECT id, name, NULL, nation FROM {c} WHERE id NOT IN (SELECT id FROM {s})", lambda s, c: writes.insert_many(s, c))
_verb("set_many_shallow", "SELECT coalesce(c.id, s.id) AS id, coalesce(c.name, s.name) AS name, s.bal, c.nation FROM {s} s FULL JOIN {c} c ON s.id = c.id", lambda s, c: writes.set_many(s, c))
_verb("set_many_overwrite", "SELECT coalesce(c.id, s.id) AS id, CASE WHEN c.id IS NULL THEN s.name ELSE c.name END AS name, CASE WHEN c.id IS NULL THEN s.bal END AS bal, c.nation FROM {s} s FULL JOIN {c} c ON s.id = c.id", lambda s, c: writes.set_many(s, c, overwrite=True))
_verb("set_many_update_only", "SELECT s.id, coalesce(c.name, s.name) AS name, s.bal, c.nation FROM {s} s LEFT JOIN {c} c ON s.id = c.id", lambda s, c: writes.set_many(s, c, update_only=True))
_verb("set_many_insert_only", "SELECT coalesce(s.id, c.id) AS id, CASE WHEN s.id IS NULL THEN c.name ELSE s.name END AS name, s.bal, CASE WHEN s.id IS NULL THEN c.nation END AS nation FROM {s} s FULL JOIN {c} c ON s.id = c.id", lambda s, c: writes.set_many(s, c, insert_only=True))
_verb("set_many_set_on_insert", "SELECT coalesce(c.id, s.id) AS id, coalesce(c.name, s.name) AS name, CASE WHEN s.id IS NULL THEN -1.0 ELSE s.bal END AS bal, c.nation FROM {s} s FULL JOIN {c} c ON s.id = c.id", lambda s, c: writes.set_many(s, c, set_on_insert={"bal": -1.0, "name": "unused"}))
_verb("set_with_clock", "SELECT coalesce(c.id, s.id) AS id, coalesce(c.name, s.name) AS name, CASE WHEN c.id IS NOT NULL THEN TIMESTAMP '2024-01-02 03:04:05' END AS _updateDate, CASE WHEN s.id IS NULL THEN TIMESTAMP '2024-01-02 03:04:05' END AS _createDate FROM {s} s FULL JOIN {c} c ON s.id = c.id", lambda s, c: writes.set_doc(s, c, CLOCK).select("id", "name", "_updateDate", "_createDate"))
_verb("insert_unique_key", "SELECT id, name FROM {s} UNION ALL SELECT id, name FROM (SELECT min_by(id, CAST(id AS INT)) AS id, name FROM {c} WHERE id NOT IN (SELECT id FROM {s}) GROUP BY name)", lambda s, c: writes.insert_many(s.select("id", "name"), c.select("id", "name").withColumn("__at", F.col("id").cast("int")), unique=[["name"]]).select("id", "name"))
_verb("write_changes", "SELECT count(*) FILTER (s.id IS NULL) AS inserted, 0::BIGINT AS removed, count(*) FILTER (s.id IS NOT NULL AND c.id IS NOT NULL) AS modified FROM {s} s FULL JOIN {c} c ON s.id = c.id", lambda s, c: writes.changes(s, writes.set_many(s, c)))


@query("set_many_merge", "SELECT CAST(p_partkey AS VARCHAR) AS id, array_to_string(CASE WHEN p_size > 10 THEN list_concat(tags, CASE WHEN list_contains(tags, 'red') THEN ['x'] ELSE ['red', 'x'] END) ELSE tags END, ',') AS tags, CASE WHEN p_size > 10 THEN 1 ELSE p_size END AS a, p_brand AS b FROM " + TAGGED)
def set_many_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _tags(table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("string").alias("id"), "tags", F.struct(F.col("p_size").alias("a"), F.col("p_brand").alias("b")).alias("o"))
    new = parts.where("o.a > 10").select("id", F.array(F.lit("red"), F.lit("x")).alias("tags"), F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b")).alias("o"))
    return writes.set_many(parts, new, merge=True).select("id", F.array_join("tags", ",").alias("tags"), "o.a", "o.b")


@query("delete_many", f"SELECT o_orderkey, status FROM {NULLABLE} WHERE NOT coalesce(status = 'F' AND o_totalprice > 100000, false)")
def delete_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.delete_many(_status(table(spark, sf_dir, "orders")), {"status": "F", "o_totalprice": {"$gt": 100000}}).select("o_orderkey", "status")


@query("delete_one", "SELECT s_suppkey FROM supplier WHERE s_suppkey <> (SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 1)")
def delete_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").withColumn("id", F.col("s_suppkey").cast("string"))
    return writes.delete_one(rows, {}, sort=["s_acctbal", "s_suppkey"]).select("s_suppkey")


@query("soft_delete_view", "SELECT c_custkey, c_acctbal >= 0 AS seen FROM customer")
def soft_delete_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = writes.soft_delete_many(table(spark, sf_dir, "customer"), {"c_acctbal": {"$lt": 0}}, CLOCK)
    seen = find.find_many(marked, {}, hide_deleted=True).select("c_custkey", F.lit(True).alias("seen"))
    gone = find.find_many(marked, {"_isDeleted": True}, hide_deleted=True).select("c_custkey", F.lit(False).alias("seen"))
    return seen.unionByName(gone)


@query("unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.broken_unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- T: the tree region, nation, customer and supplier

NODES = """(SELECT 'r:' || r_regionkey AS id, '/' AS parentId, r_name AS name, true AS isDir, 0 AS size FROM region
UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, n_name, true, 0 FROM nation
UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, c_name, false, c_custkey FROM customer
UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, s_name, false, s_suppkey * 10 FROM supplier)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as a tree of files in directories."""
    parts = []
    for source, mark, key, parent, name, folder, size in (
        ("region", "r", "r_regionkey", None, "r_name", True, "0"),
        ("nation", "n", "n_nationkey", ("r", "n_regionkey"), "n_name", True, "0"),
        ("customer", "c", "c_custkey", ("n", "c_nationkey"), "c_name", False, "c_custkey"),
        ("supplier", "s", "s_suppkey", ("n", "s_nationkey"), "s_name", False, "s_suppkey * 10"),
    ):
        above = F.concat(F.lit(f"{parent[0]}:"), F.col(parent[1]).cast("string")) if parent else F.lit(tree.ROOT)
        parts.append(table(spark, sf_dir, source).select(F.concat(F.lit(f"{mark}:"), F.col(key).cast("string")).alias("id"), above.alias("parentId"), F.col(name).alias("name"), F.lit(folder).alias("isDir"), F.expr(size).cast("long").alias("size")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({"type": F.substring("id", 1, 1), "modif": F.lit(1).cast("long"), "cmodif": F.lit(None).cast("long"), "index": F.concat(F.substring("id", 1, 1), F.lpad(F.substring("id", 3, 20), 12, "0"), F.lit("V")), **{c: F.lit(None).cast("long") for c in ("csize", "ctotal", "cftotal")}, "childLastIndex": F.lit(None).cast("string")})


def rolled(nodes: str) -> str:
    """SQL of the roll-ups of a list of nodes (id, parentId, isDir, size)."""
    return f"""(WITH RECURSIVE n AS (SELECT * FROM {nodes}), up AS (
  SELECT id, parentId AS anc, isDir, size FROM n
  UNION ALL SELECT up.id, n.parentId, up.isDir, up.size FROM up JOIN n ON up.anc = n.id)
SELECT anc AS id, count(*) AS ctotal, nullif(count(*) FILTER (NOT isDir), 0) AS cftotal, nullif(CAST(sum(size) AS BIGINT), 0) AS csize FROM up GROUP BY anc)"""


def placed(nodes: str) -> str:
    """SQL of each node with its directory, name, size and roll-ups."""
    return f"SELECT n.id, n.parentId, n.name, CAST(n.size AS BIGINT) AS size, coalesce(r.ctotal, 0) AS ctotal, coalesce(r.cftotal, 0) AS cftotal, coalesce(r.csize, 0) AS csize FROM {nodes} n LEFT JOIN {rolled(nodes)} r ON n.id = r.id"


PLACED = ["id", "parentId", "name", "size", "ctotal", "cftotal", "csize"]
ROLLED = rolled(NODES)


def kept_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree as verbs expect it: its roll-ups are right, and its rows are written."""
    return settled(tree.refreshed(nodes(spark, sf_dir)))


@query("tree_rollup", f"SELECT id, ctotal, coalesce(cftotal, 0) AS cftotal, coalesce(csize, 0) AS csize FROM {ROLLED}")
def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.roll_ups(nodes(spark, sf_dir)).select("id", "ctotal", "cftotal", "csize").na.fill(0)


@query("tree_refreshed", f"SELECT n.id, coalesce(r.ctotal, 0) AS ctotal, coalesce(r.cftotal, 0) AS cftotal, coalesce(r.csize, 0) AS csize FROM {NODES} n LEFT JOIN {ROLLED} r ON n.id = r.id")
def tree_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.refreshed(nodes(spark, sf_dir)).select("id", "ctotal", "cftotal", "csize").na.fill(0)


@query("tree_descendants", "SELECT id FROM (SELECT 'n:' || n_nationkey AS id, n_regionkey AS r FROM nation UNION ALL SELECT 'c:' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 's:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE r IN (1, 3)")
def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.descendants(nodes(spark, sf_dir), ["r:1", "r:3", "none"]).select("id")


@query("tree_ancestors", "SELECT 'c:' || c_custkey AS id, unnest(['n:' || n_nationkey, 'r:' || n_regionkey, '/']) AS ancestor, unnest([1, 2, 3]) AS distance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (1, 2, 3)")
def tree_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.ancestors(nodes(spark, sf_dir), ["c:1", "c:2", "c:3"])


@query("tree_top_selected", "SELECT id FROM (SELECT 'r:1' AS id UNION ALL SELECT 'n:' || n_nationkey FROM nation WHERE n_regionkey <> 1 AND n_nationkey < 6)")
def tree_top_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.top_selected(nodes(spark, sf_dir), ["r:1", *(f"n:{k}" for k in range(6))]).select("id")


@query("tree_list_nodes", "SELECT id, name FROM (SELECT 'c:' || c_custkey AS id, c_name AS name, c_custkey FROM customer WHERE c_nationkey = 7) ORDER BY c_custkey LIMIT 15")
def tree_list_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.list_nodes(nodes(spark, sf_dir), "n:7", only_types=["c"], only_not_types=["c"], filter_={"parentId": "n:7"}, limit=15, projection=["id", "name"])


WITHOUT_R2 = f"(SELECT * FROM {NODES} WHERE id <> 'r:2' AND parentId <> 'r:2' AND parentId NOT IN (SELECT 'n:' || n_nationkey FROM nation WHERE n_regionkey = 2))"


@query("tree_delete_subtree", placed(WITHOUT_R2))
def tree_delete_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.delete_nodes(kept_tree(spark, sf_dir), ["r:2"], 5).tree.select(*PLACED).na.fill(0)


MOVED = NODES.replace("'r:' || n_regionkey", "CASE WHEN n_nationkey = 3 THEN 'r:4' ELSE 'r:' || n_regionkey END")


@query("tree_move", placed(MOVED))
def tree_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.move_nodes(kept_tree(spark, sf_dir), ["n:3"], "r:4", 5).tree.select(*PLACED).na.fill(0)


@query("tree_presync", f"SELECT id, CASE WHEN size % 3 = 0 THEN 'stale' ELSE 'same' END AS state FROM {NODES} UNION ALL SELECT 'gone:' || p_partkey, 'deleted' FROM part")
def tree_presync(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = nodes(spark, sf_dir)
    seen = have.select("id", F.when(F.col("size") % 3 == 0, 0).otherwise(1).cast("long").alias("modif"), F.lit(None).cast("long").alias("cmodif"))
    gone = table(spark, sf_dir, "part").select(F.concat(F.lit("gone:"), F.col("p_partkey").cast("string")).alias("id"), F.lit(9).cast("long").alias("modif"), F.lit(None).cast("long").alias("cmodif"))
    return tree.presync(have, seen.unionByName(gone))


@query("tree_dead_nodes", f"SELECT id FROM {NODES} WHERE parentId IN (SELECT 'n:' || n_nationkey FROM nation WHERE n_regionkey = 0) OR parentId = 'r:0'")
def tree_dead_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.dead_nodes(nodes(spark, sf_dir).where("id <> 'r:0'")).select("id")
