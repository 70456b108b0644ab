"""Further queries with SQL: stored tables, callbacks, and the verbs of trees. They register beside those of
:mod:`fernbase.queries`."""

from __future__ import annotations

import io
import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import queries as Q
from .errors import QueryError, UniqueError
from .functions import documents
from .operators import find, tree, writes
from .queries import CLOCK, NODES, PLACED, STORED, kept_tree, nodes, placed, query, rolled, table
from .sources.scratch import new_folder, settled
from .table import DocTable, Hooks, Options, TreeTable, define_default_root, define_table


def _new(spark: SparkSession, options: Options | None = None, hooks: Hooks | None = None, schema: str | None = None) -> DocTable:
    return DocTable(spark, new_folder(spark, "table"), schema, options, hooks, now=lambda: CLOCK)


def _people(spark: SparkSession, sf_dir: str, options: Options | None = None, hooks: Hooks | None = None) -> DocTable:
    """A stored table of all customers: id, name, bal."""
    out = _new(spark, options, hooks)
    out.insert_many(Q._stored(spark, sf_dir))
    return out


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))


SUPPLIERS = "(SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_nationkey AS nation FROM supplier)"

# --- S, W18-W20, X: stored tables


@query("store_snapshots", f"SELECT 'now' AS version, id, CASE WHEN bal < 0 THEN 0 ELSE bal END AS bal FROM {STORED} UNION ALL SELECT 'before', id, bal FROM {STORED}")
def store_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir)
    before = people.store.version()
    people.update_many({"bal": {"$lt": 0}}, {"$set": {"bal": 0.0}})
    rows = lambda df, name: df.select(F.lit(name).alias("version"), "id", "bal")
    return rows(people.find(), "now").unionByName(rows(people.store.read(before), "before"))


@query("store_factory", f"SELECT id, name, true AS one FROM {SUPPLIERS}")
def store_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    define_default_root(new_folder(spark, "root"))
    made = define_table("suppliers", schema="name string, nation int")
    made(spark).insert_many(_suppliers(spark, sf_dir))
    one = made(spark) is made(spark)
    out = made(spark).find().select("id", "name", F.lit(one).alias("one"))
    made(spark).close()
    define_default_root(None)
    return out


@query("store_zstd", f"SELECT id, name, true AS packed FROM {STORED}")
def store_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir, Options(compression="zstd"))
    return people.find(projection=["id", "name"]).withColumn("packed", F.input_file_name().contains("zstd"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a value of most types."""
    return _suppliers(spark, sf_dir).withColumns(
        {
            "day": F.date_add(F.lit("2024-01-01").cast("date"), F.col("nation")),
            "at": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("nation")),
            "raw": F.encode("name", "utf-8"),
            "tags": F.array("name", F.lit(None).cast("string")),
            "inner": F.struct(F.col("nation").alias("n"), (F.col("nation") / 3).alias("third")),
            "none": F.lit(None).cast("double"),
        }
    )


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "name", F.col("day").cast("string").alias("day"), F.unix_timestamp("at").alias("at"), F.decode("raw", "utf-8").alias("raw"), F.size("tags").cast("long").alias("n_tags"), F.col("tags")[0].alias("tag"), "inner.n", F.round("inner.third", 9).alias("third"), F.col("none").isNull().alias("empty"))


TYPED = f"SELECT id, name, CAST(CAST(DATE '2024-01-01' + nation AS DATE) AS VARCHAR) AS day, CAST(1700000000 + nation AS BIGINT) AS at, name AS raw, 2::BIGINT AS n_tags, name AS tag, nation AS n, round(nation / 3, 9) AS third, true AS empty FROM {SUPPLIERS}"


@query("backup_framed", TYPED)
def backup_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, other, out = _new(spark), _new(spark), io.BytesIO()
    one.insert_many(_typed(spark, sf_dir))
    one.export_binary(out)
    other.import_binary(io.BytesIO(out.getvalue()))
    return _shown(other.find())


@query("backup_framed_ids", f"SELECT id, CASE WHEN nation = 3 THEN name ELSE 'old' END AS name FROM {SUPPLIERS}")
def backup_framed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, other, out = _new(spark), _new(spark), io.BytesIO()
    one.insert_many(_suppliers(spark, sf_dir))
    other.insert_many(_suppliers(spark, sf_dir).withColumn("name", F.lit("old")))
    one.export_binary(out, compress=False)
    wanted = [r.id for r in one.find_many({"nation": 3}, projection=["id"])]
    other.import_binary(io.BytesIO(out.getvalue()), doc_ids=wanted)
    return other.find(projection=["id", "name"])


@query("backup_folder", TYPED)
def backup_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, other, path = _new(spark), _new(spark), new_folder(spark, "backup")
    one.insert_many(_typed(spark, sf_dir))
    one.export_folder(path)
    other.insert_one({"id": "gone", "name": "x"})
    other.import_folder(path, clear=True)
    return _shown(other.find())


@query("table_life", f"SELECT 'compacted' AS step, id, true AS ok FROM {SUPPLIERS} UNION ALL SELECT 'cleared', NULL, true UNION ALL SELECT 'dropped', NULL, true")
def table_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _new(spark, Options(indexes=[{"keys": ["nation"]}]))
    one.insert_many(_suppliers(spark, sf_dir).repartition(5))
    one.compact()
    kept = settled(one.find(projection=["id"])).select(F.lit("compacted").alias("step"), "id", F.lit(len(one.df.inputFiles()) == 1).alias("ok"))
    one.clear()
    cleared = one.count() == 0
    one.drop()
    dropped = one.store.version() == 0
    return kept.unionByName(spark.createDataFrame([("cleared", None, cleared), ("dropped", None, dropped)], "step string, id string, ok boolean"))


@query("transaction_all_or_nothing", f"SELECT id, CASE WHEN bal >= 5000 THEN 'rich' ELSE name END AS name, 2::BIGINT AS commits, true AS refused FROM {STORED} WHERE bal >= 0")
def transaction_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir)
    before = people.store.version()
    refused = False
    try:
        with people.transaction():
            people.delete_many({})
            people.update_many({}, {"$bad": 1})
    except QueryError:
        refused = people.store.version() == before
    with people.transaction():
        people.delete_many({"bal": {"$lt": 0}})
        with people.transaction():
            people.update_many({"bal": {"$gte": 5000}}, {"$set": {"name": "rich"}})
    commits = people.store.version() - before + 1
    return people.find(projection=["id", "name"]).withColumns({"commits": F.lit(commits).cast("long"), "refused": F.lit(refused)})


@query("unique_index", f"SELECT id, nation, true AS refused FROM (SELECT id, nation, row_number() OVER (PARTITION BY nation ORDER BY CAST(id AS INT)) AS r FROM {SUPPLIERS}) WHERE r = 1")
def unique_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _new(spark, Options(unique=[["nation"]]))
    one.insert_many(_suppliers(spark, sf_dir).withColumn("__at", F.col("id").cast("int")))
    refused = False
    try:
        one.update_many({}, {"$set": {"nation": 1}})
    except UniqueError:
        refused = True
    return one.find(projection=["id", "nation"]).withColumn("refused", F.lit(refused))


@query("writers_take_turns", f"SELECT id, nation + 3 AS nation FROM {SUPPLIERS}")
def writers_take_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _new(spark)
    one.insert_many(_suppliers(spark, sf_dir))
    path, failed = one.store.root, []

    def work() -> None:
        try:
            DocTable(spark, path).update_many({}, {"$inc": {"nation": 1}})
        except Exception as e:
            failed.append(e)

    turns = [threading.Thread(target=work) for _ in range(3)]
    for t in turns:
        t.start()
    for t in turns:
        t.join()
    if failed:
        raise failed[0]
    return one.find(projection=["id", "nation"])


def _indexed(spark: SparkSession, sf_dir: str) -> DocTable:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.split("p_name", " ").alias("tags"), F.col("p_size").alias("size"))
    out = _new(spark, Options(indexes=[{"keys": ["tags"], "side": True}, {"keys": ["size"], "side": True}]))
    out.insert_many(parts)
    return out


@query("index_array", f"SELECT CAST(p_partkey AS VARCHAR) AS id, 'tags' AS used FROM {Q.TAGGED} WHERE list_contains(tags, 'red') AND p_size > 20")
def index_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _indexed(spark, sf_dir)
    wanted: dict[str, Any] = {"tags": "red", "size": {"$gt": 20}}
    return parts.find(wanted, projection=["id"]).withColumn("used", F.lit(parts.explain(wanted)["index"]))


@query("index_array_in", f"SELECT CAST(p_partkey AS VARCHAR) AS id, 'tags' AS used FROM {Q.TAGGED} WHERE list_contains(tags, 'red') OR list_contains(tags, 'blue')")
def index_array_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _indexed(spark, sf_dir)
    wanted = {"tags": {"$in": ["red", "blue"]}}
    return parts.find(wanted, projection=["id"]).withColumn("used", F.lit(parts.explain(wanted)["index"]))


@query("index_scalar", "SELECT CAST(p_partkey AS VARCHAR) AS id, 'size' AS used FROM part WHERE p_size = 7")
def index_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _indexed(spark, sf_dir)
    parts.update_many({"size": 8}, {"$set": {"size": -8}})  # every version has its own side tables
    return parts.find({"size": 7}, projection=["id"]).withColumn("used", F.lit(parts.explain({"size": 7})["index"]))


# --- F, Q: what the other queries leave out

UNKNOWN = ["$foo", "$text", "$where"]


@query("filter_unknown_operator", " UNION ALL ".join(f"SELECT '{op}' AS op, true AS refused" for op in UNKNOWN))
def filter_unknown_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for op in UNKNOWN:
        try:
            find.find_many(table(spark, sf_dir, "nation"), {"n_name": {op: 1}})
            rows.append((op, False))
        except QueryError:
            rows.append((op, True))
    return spark.createDataFrame(rows, "op string, refused boolean")


Q.filtered("filter_eq_explicit", "orders", {"o_orderstatus": {"$eq": "P"}, "o_totalprice": {"$gte": 1000}}, Q.ORDER, "o_orderstatus = 'P' AND o_totalprice >= 1000")


@query("find_mixed_types", "SELECT n_nationkey, row_number() OVER (ORDER BY CASE n_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 4 END, CASE WHEN n_nationkey % 4 = 1 THEN n_nationkey WHEN n_nationkey % 4 = 3 THEN n_nationkey END, CASE WHEN n_nationkey % 4 = 2 THEN n_name END) AS place FROM nation WHERE n_nationkey % 4 <> 0")
def find_mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime as dt

    rows = [(r.n_nationkey, r.n_name) for r in table(spark, sf_dir, "nation").collect()]
    values = {0: lambda k, n: None, 1: lambda k, n: k, 2: lambda k, n: n, 3: lambda k, n: dt.datetime(2024, 1, 1 + k)}
    docs = spark.createDataFrame([(k, documents.dumps({"v": values[k % 4](k, n)})) for k, n in rows], "n_nationkey int, data string")
    order = [r.n_nationkey for r in documents.sort_documents(docs, "v").collect()]
    none = sum(k % 4 == 0 for k in order)
    return spark.createDataFrame([(k, i - none + 1) for i, k in enumerate(order) if i >= none], "n_nationkey int, place long")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with insertion numbers that run against their ids."""
    return _suppliers(spark, sf_dir).withColumn("_id", -F.col("id").cast("long"))


@query("find_insertion_order", f"SELECT id FROM {SUPPLIERS} ORDER BY CAST(id AS INT) DESC LIMIT 30 OFFSET 5")
def find_insertion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.find_many(_numbered(spark, sf_dir), {}, limit=30, offset=5, projection=["id"])


@query("find_for_each", f"SELECT id, row_number() OVER (ORDER BY CAST(id AS INT) DESC) - 1 AS turn FROM {SUPPLIERS} WHERE nation < 20")
def find_for_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen: list[tuple[str, int]] = []
    find.for_each(_numbered(spark, sf_dir), {"nation": {"$lt": 20}}, lambda row, i: seen.append((row.id, i)))
    return spark.createDataFrame(seen, "id string, turn long")


@query("find_each_batch", f"SELECT id, (row_number() OVER (ORDER BY nation, CAST(id AS INT) DESC) - 1) // 7 + 1 AS batch FROM {SUPPLIERS}")
def find_each_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen: list[tuple[str, int]] = []
    find.each_batch(_numbered(spark, sf_dir), {}, lambda rows, stop, k: seen.extend((r.id, k) for r in rows), page_size=7, sort=["nation"])
    return spark.createDataFrame(seen, "id string, batch long")


@query("find_row_number", f"SELECT -CAST(id AS BIGINT) AS _id FROM {SUPPLIERS}")
def find_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = "_id" in find.find_many(_numbered(spark, sf_dir), {}).columns
    return find.find_many(_numbered(spark, sf_dir), {}, projection={"_id": 1}).where(F.lit(not hidden))


@query("find_preset", f"SELECT id, bal FROM {STORED} WHERE bal > 1000")
def find_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir, Options(presets={"short": ["id", "bal"]}))
    try:
        people.find({}, projection="long")
    except QueryError:
        return people.find({"bal": {"$gt": 1000}}, projection="short")
    raise AssertionError("an unknown preset was taken")


@query("find_page_totals", "SELECT count(*) AS total, count(*) > 40 AS has_next, least(20, greatest(0, count(*) - 20)) AS n_rows FROM orders WHERE o_orderstatus = 'F'")
def find_page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = find.list_paging(table(spark, sf_dir, "orders"), {"o_orderstatus": "F"}, page_index=2, page_size=20, get_total=True, sort=["o_orderkey"])
    return spark.createDataFrame([(page.total, page.has_next, len(page.rows))], "total long, has_next boolean, n_rows long")


@query("find_has", "SELECT k AS id, k IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) AS there FROM (VALUES ('1'), ('42'), ('-3'), ('x')) t(k)")
def find_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir)
    return spark.createDataFrame([(k, people.has(k)) for k in ("1", "42", "-3", "x")], "id string, there boolean")


@query("find_natural_order", "SELECT id, row_number() OVER (ORDER BY n, p_partkey) AS place FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, p_size * 10 ** (p_partkey % 3 * 9)::HUGEINT AS n FROM part) ORDER BY n, p_partkey LIMIT 60")
def find_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.concat(F.lit("file 00"), F.col("p_size").cast("string"), F.repeat(F.lit("0"), (F.col("p_partkey") % 3 * 9).cast("int")))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_partkey", digits.alias("label"))
    page = find.find_many(parts, {}, sort=["label", "p_partkey"], natural_sort=True, limit=60, projection=["id"]).collect()
    return spark.createDataFrame([(r.id, k) for k, r in enumerate(page, 1)], "id string, place long")


@query("explain_report", "SELECT true AS narrowed, true AS named, count(*) AS rows FROM orders WHERE o_orderstatus = 'F'")
def explain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = find.explain(table(spark, sf_dir, "orders").withColumn("tags", F.array("o_orderpriority")), {"o_orderstatus": "F", "tags": {"$exists": True}}, analyze=True)
    narrowed = not report["full_scan"] and report["run_ms"] > 0 and report["plan_ms"] > 0
    return spark.createDataFrame([(narrowed, any(r.startswith("tags: ") for r in report["reasons"]), report["rows"])], "narrowed boolean, named boolean, rows long")


# --- W, H: writes that the other queries leave out


@query("insert_auto_id", "SELECT s_name AS name, 32::BIGINT AS n_chars, true AS own FROM supplier")
def insert_auto_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _new(spark)
    one.insert_many([{"name": r.s_name} for r in table(spark, sf_dir, "supplier").select("s_name").collect()])
    alone = F.count("*").over(Window.partitionBy("id")) == 1
    return one.find().select("name", F.length("id").cast("long").alias("n_chars"), alone.alias("own"))


@query("set_many_paths", f"SELECT id, name, CASE id WHEN '1' THEN 5 WHEN '2' THEN NULL ELSE nation END AS code, CASE WHEN id = '3' THEN 'new' ELSE name END AS label, CASE WHEN id = '4' THEN NULL ELSE nation END AS nation FROM {SUPPLIERS} UNION ALL SELECT 'x', NULL, 9, NULL, NULL")
def set_many_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _new(spark)
    one.insert_many(_suppliers(spark, sf_dir).withColumn("o", F.struct(F.col("nation").alias("code"), F.col("name").alias("label"))))
    one.set_many([{"id": "1", "o.code": 5}, {"id": "2", "o.code": None}, {"id": "3", "o.label": "new"}, {"id": "4", "nation": None}, {"id": "x", "o.code": 9}])
    return one.find().select("id", "name", "o.code", "o.label", "nation")


@query("bulk_update_mixed", f"SELECT id, CASE id WHEN '1' THEN 'b' WHEN '2' THEN 'zz' ELSE name END AS name, CASE WHEN id = '1' THEN 1012 WHEN id = '3' THEN nation * 2 + 1 WHEN id = (SELECT id FROM {SUPPLIERS} WHERE nation = 4 ORDER BY name LIMIT 1) THEN -1 ELSE nation END AS nation FROM {SUPPLIERS} WHERE id NOT IN ('1', '2', '3') OR nation <> 4 UNION ALL SELECT 'u', 'made', 8")
def bulk_update_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _suppliers(spark, sf_dir).where("id NOT IN ('1', '2', '3') OR nation <> 4")
    items = [
        {"filter": {"id": "1"}, "update": {"$set": {"nation": 1000, "name": "a"}}},
        {"filter": {"id": "3"}, "update": {"$mul": {"nation": 2}}},
        {"filter": {"id": "u"}, "update": {"$inc": {"nation": 1}}},  # not there yet: nothing happens
        {"filter": {"id": "u"}, "update": {"$set": {"name": "made"}, "$inc": {"nation": 3}}, "options": {"upsert": True}},
        {"filter": {"id": "1"}, "update": {"$inc": {"nation": 12}, "$set": {"name": "b"}}},
        {"filter": {"nation": 4}, "update": {"$set": {"nation": -1}}, "options": {"sort": ["name"]}},
        {"filter": {"id": "u"}, "update": {"$inc": {"nation": 5}}},
        {"filter": {"id": "2"}, "update": {"$max": {"name": "zz"}}},
        {"filter": {"id": "3"}, "update": {"$inc": {"nation": 1}}},
    ]
    return writes.bulk_update(rows, items).select("id", "name", "nation")


@query("bulk_update_many", "SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(s_nationkey + s_suppkey % 50 AS INT) AS nation FROM supplier")
def bulk_update_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many items as there are suppliers, each by id."""
    rows = _suppliers(spark, sf_dir)
    items = [{"filter": {"id": r.id}, "update": {"$inc": {"nation": int(r.id) % 50}}} for r in rows.select("id").collect()]
    return writes.bulk_update(rows, items).select("id", F.col("nation").cast("int").alias("nation"))


@query("hooks", f"SELECT id, upper(name) AS name, 1 AS mark FROM {SUPPLIERS} WHERE nation > 10")
def hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Hooks(
        check_filter=lambda f: {**f, "nation": {"$gt": 10}},
        check_update=lambda u: {"$set": {"mark": 1}},
        check_input=lambda df: df.withColumn("mark", F.lit(0)),
        check_output=lambda df: df.withColumn("name", F.upper("name")),
        check_find_options=lambda o: {**o, "projection": ["id", "name", "mark"]},
    )
    one = _new(spark, hooks=own)
    one.insert_many(_suppliers(spark, sf_dir))
    one.update_many({}, {"$set": {"mark": 99}})
    return one.find()


# --- T: verbs of trees

CHECKS: list[dict[str, Any]] = [{"id": "", "name": "a"}, {"id": "a", "name": ""}, {"id": "a", "name": "b/c"}, {"id": "a", "name": "b", "size": -1}, {"id": "a", "name": "b", "size": float("nan")}, {"id": "a", "name": "b", "isDir": 1}]


@query("tree_node_checks", f"SELECT unnest(range({len(CHECKS)})) AS k, true AS refused")
def tree_node_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for k, node in enumerate(CHECKS):
        try:
            tree.check_node(node)
            rows.append((k, False))
        except QueryError:
            rows.append((k, True))
    return spark.createDataFrame(rows, "k long, refused boolean")


def _shape(name: str, sql: str, work: Callable[[SparkSession, str], DataFrame]) -> None:
    query(name, placed(sql))(lambda spark, sf_dir: work(spark, sf_dir).select(*PLACED).na.fill(0, ["size", "ctotal", "cftotal", "csize"]))


def _changed(sql: str, **columns: str) -> str:
    """The nodes of some SQL with other values in some columns."""
    return f"(SELECT {', '.join(f'{columns[c]} AS {c}' if c in columns else c for c in ('id', 'parentId', 'name', 'isDir', 'size'))} FROM {sql})"


ADDED = f"(SELECT * FROM {NODES} UNION ALL SELECT 'new1', 'n:7', 'new 1', true, 0 UNION ALL SELECT 'new2', 'n:7', 'new 2', false, 40 UNION ALL SELECT 'new3', 'new1', 'new 3', false, 2)"
_shape("tree_create", ADDED, lambda s, d: tree.create_nodes(settled(tree.create_nodes(kept_tree(s, d), [{"id": "new1", "name": "new 1", "isDir": True}, {"id": "new2", "name": "new 2", "size": 40}, {"id": "n:7", "name": "there already"}], "n:7", 5).tree), [{"id": "new3", "name": "new 3", "size": 2}], "new1", 6).tree)
_shape("tree_update", _changed(NODES, size="CASE WHEN NOT isDir AND size > 50 THEN 7 ELSE size END", name="CASE WHEN NOT isDir AND size > 50 THEN 'big' ELSE name END"), lambda s, d: tree.update_nodes(kept_tree(s, d), {"isDir": False, "size": {"$gt": 50}}, {"$set": {"size": 7, "name": "big", "parentId": "/", "ctotal": 99}}, 5).tree)
DEEP = f"(SELECT id FROM {NODES} WHERE id = 'r:1' OR parentId = 'r:1' OR parentId IN (SELECT 'n:' || n_nationkey FROM nation WHERE n_regionkey = 1))"
_shape("tree_update_deep", _changed(NODES, size=f"CASE WHEN id IN {DEEP} THEN size + 1000 ELSE size END"), lambda s, d: tree.update_nodes(kept_tree(s, d), {"id": "r:1"}, {"$inc": {"size": 1000}}, 5, deep=True).tree)

#: A second directory with one directory a nation, of its name, and in it some files of its customers' names: every
#: other one, of which every fourth is newer.
SECOND = "'/' AS parentId, 'second' AS name, true AS isDir, 0 AS size, 0 AS modif"
TWICE = f"(SELECT *, 1 AS modif FROM {NODES} UNION ALL SELECT 'm', {SECOND} UNION ALL SELECT 'm:' || n_nationkey, 'm', n_name, true, 0, 1 FROM nation UNION ALL SELECT 'y:' || c_custkey, 'm:' || c_nationkey, c_name, false, 100000, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 0 END FROM customer WHERE c_custkey % 2 = 0)"


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = nodes(spark, sf_dir)
    people = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    parts = [
        spark.createDataFrame([("m", "/", "second", True, 0, 0)], "id string, parentId string, name string, isDir boolean, size long, modif long"),
        table(spark, sf_dir, "nation").select(F.concat(F.lit("m:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("m").alias("parentId"), F.col("n_name").alias("name"), F.lit(True).alias("isDir"), F.lit(0).cast("long").alias("size"), F.lit(1).cast("long").alias("modif")),
        people.select(F.concat(F.lit("y:"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("m:"), F.col("c_nationkey").cast("string")).alias("parentId"), F.col("c_name").alias("name"), F.lit(False).alias("isDir"), F.lit(100000).cast("long").alias("size"), F.when(F.col("c_custkey") % 4 == 0, 2).otherwise(0).cast("long").alias("modif")),
    ]
    out = first
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    return settled(tree.refreshed(out.withColumn("index", F.coalesce("index", F.lit("")))))


def _conflict(mode: str, sql: str) -> None:
    _shape(f"tree_move_{mode}", f"(SELECT id, parentId, name, isDir, size FROM {sql})", lambda s, d: tree.move_nodes(_twice(s, d), ["n:3"], "m", 5, tree.Conflicts("name", mode)).tree)


UNDER_M3 = "(id = 'm:3' OR parentId = 'm:3')"
_conflict("replace", _changed(f"(SELECT * FROM {TWICE} WHERE NOT {UNDER_M3})", parentId="CASE WHEN id = 'n:3' THEN 'm' ELSE parentId END"))
_conflict("skip", TWICE)
_conflict("newName", _changed(TWICE, parentId="CASE WHEN id = 'n:3' THEN 'm' ELSE parentId END", name="CASE WHEN id = 'n:3' THEN name || ' (1)' ELSE name END"))
MERGED = f"(SELECT * FROM {TWICE} WHERE id <> 'n:3' AND NOT (parentId = 'm:3' AND name IN (SELECT name FROM {NODES} WHERE parentId = 'n:3')))"
_conflict("merge", _changed(MERGED, parentId="CASE WHEN parentId = 'n:3' THEN 'm:3' ELSE parentId END"))
NEWER = f"(SELECT * FROM {TWICE} WHERE id <> 'n:3' AND NOT (parentId = 'm:3' AND modif < 1 AND name IN (SELECT name FROM {NODES} WHERE parentId = 'n:3')) AND NOT (parentId = 'n:3' AND name IN (SELECT name FROM {TWICE} WHERE parentId = 'm:3' AND modif > 1)))"
_conflict("mergeByModif", _changed(NEWER, parentId="CASE WHEN parentId = 'n:3' THEN 'm:3' ELSE parentId END"))

SET = f"(SELECT * FROM {_changed(NODES, parentId='''CASE id WHEN 'c:1' THEN 's1' WHEN 'n:5' THEN 'r:0' ELSE parentId END''', size='''CASE WHEN id = 'c:1' THEN 77 ELSE size END''', name='''CASE WHEN id = 'n:5' THEN 'five' ELSE name END''')} UNION ALL SELECT 's1', 'r:2', 'set', true, 0 UNION ALL SELECT 's2', 's1', 'file', false, 11)"
_shape("tree_set_nodes", SET, lambda s, d: tree.set_nodes(kept_tree(s, d), [{"id": "s2", "name": "file", "size": 11, "parentId": "s1"}, {"id": "s1", "name": "set", "isDir": True, "parentId": "r:2"}, {"id": "c:1", "parentId": "s1", "size": 77}, {"id": "n:5", "parentId": "r:0", "name": "five"}], 5).tree)


@query("tree_set_modes", "SELECT 'c:1' AS id, 'merged' AS name, 1::BIGINT AS size, 'same' AS state UNION ALL SELECT 'c:2', 'whole', 5, 'stale' UNION ALL SELECT 'nowhere', 'added', 3, 'deleted'")
def tree_set_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tree_table(spark, sf_dir)
    states: dict[str, str] = {}
    for node, mode, old in (({"id": "c:1", "name": "merged"}, "merge", 10**15), ({"id": "c:2", "name": "whole", "size": 5, "parentId": "n:1", "isDir": False}, "overwrite", 0), ({"id": "nowhere", "name": "added", "size": 3}, "default", 1)):
        states |= files.set_nodes([{**node, "oldModif": old, "oldCmodif": old}], set_mode=mode, presync=True).states
    told = spark.createDataFrame(list(states.items()), "id string, state string")
    return files.find({"id": {"$in": list(states)}}).select("id", "name", "size").join(told, "id")


def _tree_table(spark: SparkSession, sf_dir: str) -> TreeTable:
    out = TreeTable(spark, new_folder(spark, "tree"), Options(mark_delete=True), now=lambda: CLOCK)
    out.insert_many(tree.refreshed(nodes(spark, sf_dir)))
    return out


@query("tree_one_commit", placed(_changed(NODES, parentId="CASE WHEN id = 'n:3' THEN 'r:4' ELSE parentId END")).replace("SELECT n.id", "SELECT 1::BIGINT AS commits, n.id", 1))
def tree_one_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tree_table(spark, sf_dir)
    before = files.store.version()
    try:
        files.move_nodes(["n:3"], "nowhere")  # what fails changes nothing
    except QueryError:
        files.move_nodes(["n:3"], "r:4")
    return files.find().select(F.lit(files.store.version() - before).cast("long").alias("commits"), *PLACED).na.fill(0)


@query("tree_marked", placed(Q.WITHOUT_R2))
def tree_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tree_table(spark, sf_dir)
    files.delete_nodes(["r:2"])
    return files.find().select(*PLACED).na.fill(0)


@query("tree_undelete", placed(NODES))
def tree_undelete(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tree_table(spark, sf_dir)
    files.delete_nodes(["r:2"])
    files.undelete_nodes(["r:2"])
    return files.find().select(*PLACED).na.fill(0)


@query("tree_visibility", "SELECT 'n:' || n_nationkey AS id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal >= 0) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS below, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal >= 0) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS listed FROM nation")
def tree_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.lit(True).alias("_isDeleted"))
    marked = nodes(spark, sf_dir).join(poor, "id", "left")
    listed = tree.live(marked).groupBy(F.col("parentId").alias("id")).agg(F.count("*").alias("listed"))
    sums = tree.roll_ups(marked).select("id", F.col("ctotal").alias("below"))
    return nodes(spark, sf_dir).where("type = 'n'").select("id").join(sums, "id", "left").join(listed, "id", "left").na.fill(0)


COPIED = f"(SELECT * FROM {NODES} UNION ALL SELECT 'k:n:3', 'n:4', n_name, true, 0 FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'k:' || id, 'k:n:3', name, isDir, size FROM {NODES} WHERE parentId = 'n:3' UNION ALL SELECT 'l:n:3', 'n:4', n_name || ' (1)', true, 0 FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'l:' || id, 'l:n:3', name, isDir, size FROM {NODES} WHERE parentId = 'n:3')"


@query("tree_copy", f"SELECT p.name AS directory, n.name, n.size, coalesce(r.ctotal, 0) AS ctotal, coalesce(r.csize, 0) AS csize FROM {COPIED} n JOIN {COPIED} p ON n.parentId = p.id LEFT JOIN {rolled(COPIED)} r ON n.id = r.id")
def tree_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory twice into another; copies have new ids, so they are told by their names."""
    once = settled(tree.copy_nodes(kept_tree(spark, sf_dir), ["n:3"], "n:4", 5).tree)
    out = settled(tree.copy_nodes(once, ["n:3"], "n:4", 6).tree)
    up = out.select(F.col("id").alias("parentId"), F.col("name").alias("directory"))
    return out.join(up, "parentId").select("directory", "name", "size", "ctotal", "csize").na.fill(0)


@query("tree_order", "SELECT id, row_number() OVER (ORDER BY k) AS place FROM (SELECT 'c:' || c_custkey AS id, c_custkey + 10.0 AS k FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 's:' || s_suppkey, 1e9 + s_suppkey FROM supplier WHERE s_nationkey = 7 UNION ALL SELECT 'first', 0 UNION ALL SELECT 'last1', 2e9 UNION ALL SELECT 'last2', 3e9 UNION ALL SELECT 'middle', 2.5e9)")
def tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kept_tree(spark, sf_dir)
    for ids, place in ((["last1", "last2"], tree.Place(to_end=True)), (["first"], tree.Place(to_start=True)), (["middle"], tree.Place(previous="last1", next="last2"))):
        out = settled(tree.create_nodes(out, [{"id": i, "name": i} for i in ids], "n:7", 5, place).tree)
    place = F.row_number().over(Window.partitionBy("parentId").orderBy("index", "id"))
    return out.where("parentId = 'n:7'").select("id", place.cast("long").alias("place"))


@query("tree_rebalanced", f"SELECT id, row_number() OVER (ORDER BY id) AS place, 0::BIGINT AS shared FROM {NODES} WHERE parentId = 'n:7'")
def tree_rebalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = nodes(spark, sf_dir).withColumn("index", F.lit("V"))
    out = tree.rebalanced(same, "n:7").where("parentId = 'n:7'")
    place = F.row_number().over(Window.partitionBy("parentId").orderBy("index"))
    shared = F.count("*").over(Window.partitionBy("index")) - 1
    return out.select("id", place.cast("long").alias("place"), shared.alias("shared"))


@query("tree_repaired_names", f"SELECT id, CASE r WHEN 1 THEN 'same.txt' ELSE 'same (' || (r - 1) || ').txt' END AS name FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM {NODES} WHERE parentId = 'n:7') UNION ALL SELECT id, name FROM {NODES} WHERE parentId <> 'n:7'")
def tree_repaired_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = nodes(spark, sf_dir).withColumn("name", F.when(F.col("parentId") == "n:7", F.lit("same.txt")).otherwise(F.col("name")))
    return tree.repaired_names(same, "n:7").select("id", "name")


@query("tree_cursor", "SELECT 'c:' || c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey = 7 AND c_name > 'Customer#000000020' ORDER BY c_name LIMIT 5")
def tree_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = tree.list_by_cursor(nodes(spark, sf_dir).where("type = 'c'"), "n:7", sort_key="name", cursor="Customer#000000020", page_size=5)
    return spark.createDataFrame([(r.id, r.name) for r in page.rows], "id string, name string")


@query("tree_would_overwrite", f"SELECT id FROM {TWICE} WHERE parentId = 'm:3' AND name IN (SELECT c_name FROM customer WHERE c_nationkey = 3)")
def tree_would_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _twice(spark, sf_dir)
    return tree.would_overwrite(both, both.where("parentId = 'n:3'"), "m:3").select("id")
