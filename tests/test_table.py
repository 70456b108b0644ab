"""The stateful table: snapshots, transactions, hooks, backups, dynamic documents, trees."""

import datetime as dt
import io
import math

import pytest
from pyspark.sql import functions as F

from fernbase.errors import ConflictError, QueryError, UniqueError
from fernbase.functions import documents as D
from fernbase.functions import order_keys
from fernbase.functions.names import unique_names
from fernbase.operators import tree, writes
from fernbase.operators.lookup import Lookup
from fernbase.table import DocTable, Hooks, Options, TreeTable, define_default_root, define_table

NOW = dt.datetime(2024, 3, 4, 5, 6)


@pytest.fixture
def table(spark, tmp_path):
    return DocTable(spark, f"file://{tmp_path}/t", "name string, n int, tags array<string>", now=lambda: NOW)


def test_life_of_documents(table, spark):
    assert table.insert_many([{"id": "1", "name": "a", "n": 1}, {"id": "2", "name": "b", "tags": ["x"]}, {"id": "1", "name": "again"}]) == {"inserted": 2, "skipped": 1}
    assert table.get(1).name == "a" and table.has("2") and not table.has("3") and table.count() == 2
    table.set("3", {"name": "c", "extra": {"deep": 2.5}})
    assert table.get("3").extra.deep == 2.5 and table.get("1").extra is None
    assert table.update_one({"id": "1"}, {"$inc": {"n": 4}}) == {"matched": 1, "modified": 1, "upserted": 0}
    assert table.update_many({}, {"$set": {"name": "c"}})["modified"] == 2
    assert table.update_one({"id": "9"}, {"$set": {"n": 7}}, upsert=True)["upserted"] == 1
    assert [r.id for r in table.find_many({})] == ["1", "2", "3", "9"]
    assert table.delete("9") == 1 and table.delete_many({"n": None}) == 2 and table.count() == 1
    table.clear()
    assert table.count() == 0
    again = DocTable(spark, table.store.root)
    assert again.count() == 0 and "extra" in again.df.columns


def test_snapshots_and_conflicts(table, spark):
    table.insert_one({"id": "1"})
    before = table.store.version()
    other = DocTable(spark, table.store.root)
    with pytest.raises(ConflictError), other.transaction():
        other.insert_one({"id": "2"})
        table.store.commit(table.store.read(), before)
    assert table.count() == 1 and table.store.read(before).count() == 1
    assert table.update_many({"id": "none"}, {"$set": {"n": 1}})["modified"] == 0
    version = table.store.version()
    table.update_many({"id": "none"}, {"$set": {"n": 1}})
    assert table.store.version() == version  # a write that changes nothing makes no snapshot
    table.compact()
    assert table.count() == 1


def test_a_dead_writers_commit_is_finished(table, spark, monkeypatch):
    """A writer that stops after its claim: the next one gets a conflict once, and finds that commit done."""
    table.insert_one({"id": "1"})
    with monkeypatch.context() as m:
        m.setattr(type(table.store), "_finish", lambda self, version: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            table.insert_one({"id": "2"})
    other = DocTable(spark, table.store.root)
    assert other.count() == 1
    with pytest.raises(ConflictError):
        other.insert_one({"id": "3"})
    assert sorted(r.id for r in other.find_many({})) == ["1", "2"]
    other.insert_one({"id": "3"})
    assert other.count() == 3


def test_side_tables_follow_every_version(spark, tmp_path):
    t = DocTable(spark, f"file://{tmp_path}/x", "tags array<string>, n int", Options(indexes=[{"keys": ["tags"], "side": True}]))
    assert t.find_many({"tags": "a"}) == [] and t.explain({"tags": "a"})["index"] is None  # no version has one yet
    t.insert_many([{"id": "1", "tags": ["a", "b", "a"], "n": 1}, {"id": "2", "tags": [], "n": 2}, {"id": "3", "tags": ["b"], "n": 3}])
    ids = lambda f: [r.id for r in t.find_many(f)]
    assert t.explain({"tags": "a"})["index"] == "tags" and ids({"tags": "a"}) == ["1"] and ids({"tags": {"$in": ["b", "c"]}}) == ["1", "3"]
    t.update_many({"n": 3}, {"$push": {"tags": "a"}})
    assert ids({"tags": "a"}) == ["1", "3"] and ids({"tags": "a", "n": {"$gt": 1}}) == ["3"]
    assert t.explain({"tags": {"$ne": "a"}})["index"] is None and t.explain({"tags": 5})["index"] is None
    with t.transaction():
        t.delete("1")
        assert ids({"tags": "a"}) == ["3"]  # inside a transaction the staged rows are read
    t.compact()
    assert ids({"tags": "a"}) == ["3"] and t.explain({"tags": "a"})["index"] == "tags"


def test_transactions(table):
    with table.transaction():
        table.insert_one({"id": "1", "n": 1})
        with table.transaction():
            table.update_many({}, {"$set": {"n": 5}})
        assert table.get("1").n == 5
    version = table.store.version()
    with pytest.raises(RuntimeError), table.transaction():
        table.clear()
        raise RuntimeError
    assert table.count() == 1 and table.store.version() == version


def test_unique_indexes(spark, tmp_path):
    t = DocTable(spark, f"file://{tmp_path}/u", "mail string", Options(unique=[["mail"]]))
    assert t.insert_many([{"id": "1", "mail": "a"}, {"id": "2", "mail": "a"}, {"id": "3"}, {"id": "4"}])["inserted"] == 3
    with pytest.raises(UniqueError):
        t.update_many({}, {"$set": {"mail": "z"}})
    assert t.count({"mail": "a"}) == 1
    with pytest.raises(UniqueError):
        t.drop_indexes()
        t.update_many({}, {"$set": {"mail": "z"}})
        t.define_indexes([{"keys": ["mail"], "unique": True}])


def test_marks_and_metadata(spark, tmp_path):
    t = DocTable(spark, f"file://{tmp_path}/m", "n int", Options(mark_delete=True, auto_metadata=True, presets={"short": ["id"]}), now=lambda: NOW)
    t.insert_many([{"id": "1", "n": 1}, {"id": "2", "n": 2}])
    assert t.delete("1") == 1 and t.get("1") is None and t.get("1", ignore_mark_delete=True)._deleteDate == NOW
    assert t.count() == 1 and t.count(ignore_mark_delete=True) == 2 and t.count({"_isDeleted": True}) == 1
    assert t.find_one({"n": 2})._createDate == NOW and t.find({"n": 2}, projection="short").columns == ["id"]
    with pytest.raises(QueryError):
        t.find({}, projection="long")
    with pytest.raises(QueryError):
        t.find({}, skip=3)
    t.set("2", {"n": 9})
    assert t.get("2").n == 9 and t.delete("2", real_delete=True) == 1 and t.count(ignore_mark_delete=True) == 1


def test_hooks(spark, tmp_path):
    hooks = Hooks(check_filter=lambda f: {**f, "n": {"$lt": 5}}, check_input=lambda d: d.withColumn("n", F.col("n") * 2), check_output=lambda d: d.withColumn("seen", F.lit(True)), check_update=lambda u: {"$set": {"n": 1}})
    t = DocTable(spark, f"file://{tmp_path}/h", "n int", hooks=hooks)
    t.insert_many([{"id": "1", "n": 1}, {"id": "2", "n": 4}])
    assert [(r.id, r.n, r.seen) for r in t.find_many({})] == [("1", 2, True)]
    t.update_many({}, {"$set": {"n": 99}})
    assert t.get("1").n == 1


def test_lookup_between_tables(spark, tmp_path, table):
    table.insert_many([{"id": "1", "name": "a"}])
    left = DocTable(spark, f"file://{tmp_path}/l", "who string")
    left.insert_one({"id": "x", "who": "1"})
    page = left.list_paging({}, joins=[table.as_lookup("who", "id", "person", ["name"])])
    assert page.rows[0].person.name == "a" and isinstance(table.as_lookup("who", "id"), Lookup)


def test_define_table_is_one(spark, tmp_path):
    made = define_table(f"file://{tmp_path}/d", schema="n int", options=Options(compression="zstd"))
    assert made(spark) is made(spark)
    made(spark).insert_one({"id": "1", "n": 1})
    assert any("zstd" in f for f in made(spark).df.inputFiles())
    made(spark).close()


def test_default_root_and_sorted_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("fernbase.table._DEFAULT", {})
    with pytest.raises(QueryError):
        define_table("bare")(spark)
    define_default_root(f"file://{tmp_path}")
    t = define_table("bare", schema="n int", options=Options(indexes=[{"keys": ["n"]}]))(spark)
    t.insert_many([{"id": str(k), "n": (k * 7) % 50} for k in range(50)])
    t.compact(2)
    parts = t.df.withColumn("f", F.input_file_name()).groupBy("f").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).orderBy("lo").collect()
    assert t.count() == 50 and len(parts) == 2 and parts[0].hi < parts[1].lo
    assert t.store.root == f"file://{tmp_path}/bare"


@pytest.mark.parametrize("compress", [True, False])
def test_framed_backup(table, spark, tmp_path, compress):
    table.insert_many([{"id": str(k), "name": f"n{k}", "n": k, "tags": ["a", str(k)]} for k in range(2300)])
    out = io.BytesIO()
    assert table.export_binary(out, compress) == 2300
    other = DocTable(spark, f"file://{tmp_path}/o")
    other.insert_many([{"id": "5", "name": "old"}, {"id": "keep", "name": "k"}])
    assert other.import_binary(io.BytesIO(out.getvalue()), doc_ids=["5", "7"]) == 2
    assert other.get("5").name == "n5" and other.count() == 3
    other.import_binary(io.BytesIO(out.getvalue()), clear=True)
    assert other.count() == 2300 and other.get("7").tags == ["a", "7"]
    with pytest.raises(ValueError):
        other.import_binary(io.BytesIO(b"nothing at all"))
    with pytest.raises(ValueError):
        other.import_binary(io.BytesIO(out.getvalue()[: len(out.getvalue()) // 2] if not compress else b"\x00\x00\x00\x02{}"))


def test_folder_backup(table, spark, tmp_path):
    table.insert_many([{"id": str(k), "n": k} for k in range(20)])
    table.export_folder(f"file://{tmp_path}/b")
    other = DocTable(spark, f"file://{tmp_path}/o")
    other.import_folder(f"file://{tmp_path}/b", doc_ids=["3", "4"])
    assert sorted(r.n for r in other.find_many({})) == [3, 4]


VALUES = {
    "big": 2**70, "nan": float("nan"), "inf": -math.inf, "when": NOW, "day": dt.date(2024, 1, 2), "re": D.Pattern("a+", "i"), "map": D.Entries([(1, "x"), ("k", [2])]), "set": D.Distinct([1, "1"]), "bytes": b"\x00\xff",
    "file": D.Blob(b"abc", "file", "a.txt", "text/plain", 5), "error": D.Failure("TypeError", "bad", None, D.Failure("E", "cause")), "nested": {"a": [None, {"b": True}]}, "\0$t": "like a tag", "none": None,
}


def test_every_type_comes_back():
    back = D.loads(D.dumps(VALUES))
    assert math.isnan(back.pop("nan")) and back == {k: v for k, v in VALUES.items() if k != "nan"}


def test_dynamic_documents(spark):
    docs = [{"id": "1", "v": None}, {"id": "2", "v": 0}, {"id": "3", "v": ""}, {"id": "4", "v": False}, {"id": "5"}, {"id": "6", "v": [1, "a"]}, {"id": "7", "v": NOW}]
    df = spark.createDataFrame([(d["id"], D.dumps(d)) for d in docs], "id string, data string")
    ids = lambda f: [r.id for r in D.filter_documents(df, f).orderBy("id").collect()]
    assert ids({"v": None}) == ["1", "5"] and ids({"v": {"$exists": True}}) == ["1", "2", "3", "4", "6", "7"]
    assert ids({"v": 0}) == ["2"] and ids({"v": False}) == ["4"] and ids({"v": ""}) == ["3"] and ids({"v": "a"}) == ["6"]
    assert ids({"v": {"$in": [None, 0]}}) == ["1", "2"] and ids({"v": {"$gte": NOW}}) == ["7"]
    after = {r.id: D.loads(r.data) for r in D.update_documents(df, {"v": 0}, {"$set": {"w": {"k": b"x"}}}).collect()}
    assert after["2"]["w"] == {"k": b"x"} and "w" not in after["1"]
    new = spark.createDataFrame([("6", D.dumps({"v": ["a", "b"], "o": {"x": 1}})), ("8", D.dumps({"id": "8"}))], "id string, data string")
    merged = {r.id: D.loads(r.data) for r in D.merge_documents(df, new).collect()}
    assert merged["6"]["v"] == [1, "a", "b"] and merged["6"]["o"] == {"x": 1} and "8" in merged
    order = [r.id for r in D.sort_documents(df, "v").collect()]
    assert set(order[:2]) == {"1", "5"} and order[2:] == ["2", "4", "3", "7", "6"]


def test_narrowing_loses_no_document(spark):
    """Filters over values of every kind: with the JVM's narrowing as without it."""
    values = [None, 0, 1, -1, 2.5, 2**60, 2**60 + 1, 2**53 + 1, 1e300, float("nan"), math.inf, "1", "2.5", "", "a", "null", "[1]", True, False, [1, "a"], [], [[1]], {"b": 1}, [{"b": 1}, {"b": "a"}], {"b": [1, 2]}, NOW, b"x", "é\"\\"]
    docs = [{"v": v} for v in values] + [{}, {"w": 1}]
    df = spark.createDataFrame([(k, D.dumps(d)) for k, d in enumerate(docs)], "k int, data string")
    wanted = [0, 1, 2.5, 2**60, 2**53, "1", "a", "", "null", True, "é\"\\", 1e300]
    filters = [{"v": w} for w in wanted] + [{"v.b": w} for w in (1, "a")] + [{"v": {op: w}} for op in ("$gt", "$gte", "$lt", "$lte") for w in (0, 1, 2**60, 2**53, 2.5, "a")]
    filters += [{"v": {"$in": [1, "a", 2**60]}}, {"v": {"$in": [None, 1]}}, {"v": {"$gt": 0, "$lt": 2**60 + 1}}, {"v": {"$ne": 1}}, {"v.0": 1}, {"v": {"$eq": "1"}}]
    seen = 0
    for f in filters:
        want = [k for k, d in enumerate(docs) if D.matches(D.loads(D.dumps(d)), f)]
        assert [r.k for r in D.filter_documents(df, f).orderBy("k").collect()] == want, f
        seen += len(want)
    assert seen > 60
    after = D.update_documents(df, {"v": {"$gt": 1}}, {"$set": {"hit": 1}}).collect()
    assert [r.k for r in after if "hit" in D.loads(r.data)] == [k for k, d in enumerate(docs) if D.matches(D.loads(D.dumps(d)), {"v": {"$gt": 1}})]


def test_order_keys():
    a, b = order_keys.between(None, None), order_keys.between("V", None)
    assert a < b
    low, high = None, None
    for k in range(300):
        key = order_keys.between(low, high)
        assert (low is None or low < key) and (high is None or key < high) and not key.endswith("0")
        low, high = (key, high) if k % 3 else (low, key)
    keys = order_keys.after(None, 500)
    assert keys == sorted(set(keys)) and max(map(len, keys)) < 12
    keys = order_keys.spread("A", "B", 100)
    assert keys == sorted(set(keys)) and "A" < keys[0] and keys[-1] < "B"
    assert unique_names(["a.txt", "a.txt", ".x", "d"], ["a.txt", ".x", "d", "d (1)"]) == ["a (1).txt", "a (2).txt", ".x (1)", "d (2)"]


@pytest.fixture
def files(spark, tmp_path):
    t = TreeTable(spark, f"file://{tmp_path}/tree", Options(mark_delete=True), now=lambda: NOW)
    rows = [("d1", "/", True, 0), ("d2", "/", True, 0), ("e", "d1", True, 0), ("f1", "d1", False, 5), ("f2", "e", False, 7), ("f3", "e", False, 1), ("f4", "d2", False, 2)]
    names = {"f1": "f.txt", "f2": "f.txt", "f3": "g.txt", "f4": "f.txt"}
    frame = spark.createDataFrame([(i, p, names.get(i, i), d, n, "", 1) for i, p, d, n in rows], "id string, parentId string, name string, isDir boolean, size long, index string, modif long")
    t.insert_many(tree.refreshed(frame))
    return t


def test_tree_is_made_node_by_node(files, spark, tmp_path):
    t = TreeTable(spark, f"file://{tmp_path}/made", now=lambda: NOW)
    t.create_nodes([{"id": "d1", "name": "d1", "isDir": True}, {"id": "d2", "name": "d2", "isDir": True}])
    t.create_nodes([{"id": "e", "name": "e", "isDir": True}, {"id": "f1", "name": "f.txt", "size": 5}], "d1")
    t.create_nodes([{"id": "f2", "name": "f.txt", "size": 7}, {"id": "f3", "name": "g.txt", "size": 1}], "e")
    t.create_nodes([{"id": "f4", "name": "f.txt", "size": 2}, {"id": "f1", "name": "there already"}], "d2")
    shown = lambda x: sorted((r.id, r.parentId, r.name, r.size, r.ctotal, r.cftotal, r.csize) for r in x.find_many({}))
    assert shown(t) == shown(files) and right(t)


def sums(t, node):
    r = t.get(node, ignore_mark_delete=True)
    return r.ctotal, r.cftotal, r.csize


def right(t):
    return tree.wrong_roll_ups(t.df).count() == 0


def test_tree_roll_ups_and_lists(files):
    assert sums(files, "d1") == (4, 3, 13) and sums(files, "e") == (2, 2, 8) and right(files)
    assert [r.id for r in files.list_nodes("d1").collect()] == ["e", "f1"]
    assert {r.id for r in tree.descendants(files.df, ["d1"]).collect()} == {"e", "f1", "f2", "f3"}
    assert {(r.ancestor, r.distance) for r in tree.ancestors(files.df, ["f2"]).collect()} == {("e", 1), ("d1", 2), ("/", 3)}
    with pytest.raises(QueryError):
        files.create_nodes([{"name": "a/b"}])
    with pytest.raises(QueryError):
        files.create_nodes([{"name": "x"}], "nowhere")


def test_tree_moves(files):
    files.move_nodes(["e", "f2"], "d2")
    assert sums(files, "d1") == (1, 1, 5) and sums(files, "d2") == (4, 3, 10) and right(files)
    with pytest.raises(QueryError):
        files.move_nodes(["d2"], "e")
    files.move_nodes(["f1"], "d2", tree.Conflicts("name", "newName"))
    assert files.get("f1").name == "f (1).txt" and right(files)


@pytest.mark.parametrize(("mode", "left"), [("replace", {"f1"}), ("skip", {"f4"}), ("mergeByModif", {"f1"})])
def test_tree_conflicts(files, mode, left):
    files.move_nodes(["f1"], "d2", tree.Conflicts("name", mode))
    assert {r.id for r in files.list_nodes("d2").collect()} == left and right(files)


def test_tree_merge_of_directories(files):
    files.create_nodes([{"id": "e2", "name": "e", "isDir": True}], "d2")
    files.create_nodes([{"id": "f5", "name": "g.txt", "size": 100}], "e2")
    files.move_nodes(["e"], "d2", tree.Conflicts("name", "merge"))
    assert {r.id for r in files.list_nodes("e2").collect()} == {"f2", "f3"} and right(files) and not files.has("e")


def test_tree_deletes_and_comes_back(files):
    assert files.delete_nodes(["e"]) == 3 and sums(files, "d1") == (1, 1, 5) and right(files)
    files.undelete_nodes(["e"])
    assert sums(files, "d1") == (4, 3, 13) and right(files)
    assert files.delete_nodes(["e"], real_delete=True) == 3 and files.count({}, ignore_mark_delete=True) == 4


def test_tree_updates_and_sets(files):
    files.update_nodes({"id": "f2"}, {"$set": {"size": 70, "parentId": "d2", "ctotal": 9}})
    assert files.get("f2").parentId == "e" and sums(files, "d1") == (4, 3, 76) and files.get("d1").cmodif is not None
    files.set_nodes([{"id": "n2", "name": "new", "parentId": "n1"}, {"id": "n1", "name": "dir", "isDir": True, "parentId": "d2"}, {"id": "f3", "parentId": "d2", "size": 9}])
    assert sums(files, "d2") == (4, 3, 11) and right(files) and files.get("f3").parentId == "d2"
    with pytest.raises(QueryError):
        files.set_nodes([{"id": "a", "name": "a"}, {"id": "a", "name": "b"}])


def test_tree_copies_and_sync(files, spark):
    files.copy_nodes(["e"], "d1")
    assert sums(files, "d1") == (7, 5, 21) and right(files)
    assert sorted(r.name for r in files.list_nodes("d1").collect()) == ["e", "e (1)", "f.txt"]
    seen = spark.createDataFrame([("d1", 0, 0), ("zz", 1, 1)], "id string, modif long, cmodif long")
    assert {r.id: r.state for r in tree.presync(files.df, seen).collect()} == {"d1": "stale", "zz": "deleted"}
    probe = spark.createDataFrame([("q", "f.txt")], "id string, name string")
    assert {r.id for r in tree.would_overwrite(files.df, probe, "d2").collect()} == {"f4"}


def test_tree_cycles_and_dead_nodes(spark):
    rows = [("a", "/", True), ("b", "a", False), ("x", "y", True), ("y", "x", True), ("z", "none", False)]
    df = spark.createDataFrame([(i, p, i, d) for i, p, d in rows], "id string, parentId string, name string, isDir boolean")
    for c, kind in (("type", "string"), ("modif", "long"), ("cmodif", "long"), ("index", "string"), ("size", "long")):
        df = df.withColumn(c, F.lit(None).cast(kind))
    assert {r.id for r in tree.dead_nodes(df).collect()} == {"x", "y", "z"}
    with pytest.raises(QueryError):
        tree.closure(df)
    with pytest.raises(QueryError):
        tree.ancestors(df, ["x"])
    assert {r.id for r in tree.descendants(df, ["x"], include_self=True).collect()} == {"x", "y"}
    assert tree.without_dead(df).count() == 2


def test_tree_order_keys(spark, files):
    files.create_nodes([{"id": "k1", "name": "k1"}, {"id": "k2", "name": "k2"}], "d2", tree.Place(to_end=True))
    files.create_nodes([{"id": "k3", "name": "k3"}], "d2", tree.Place(previous="k1", next="k2"))
    order = [r.id for r in files.list_nodes("d2").collect()]
    assert order.index("k1") < order.index("k3") < order.index("k2")
    same = files.df.withColumn("index", F.when(F.col("parentId") == "d2", F.lit("V")).otherwise(F.col("index")))
    keys = [r["index"] for r in tree.rebalanced(same, "d2").where("parentId = 'd2'").collect()]
    assert len(set(keys)) == 4 and not any(k.endswith("0") for k in keys)
    names = tree.repaired_names(files.df.withColumn("name", F.when(F.col("parentId") == "d2", F.lit("s")).otherwise(F.col("name"))), "d2")
    assert sorted(r.name for r in names.where("parentId = 'd2'").collect()) == ["s", "s (1)", "s (2)", "s (3)"]


def test_free_names_are_those_of_the_plain_rule(spark, files):
    import random

    rng = random.Random(4)
    pool = ["a.txt", "a (1).txt", "a (2).txt", "a (7).txt", "b", "b (1)", ".x", ".x (1)", "a(1).txt", "c.tar.gz", "c.tar (1).gz", "(1)", "a (01).txt"]
    for _ in range(4):
        there, wanted = rng.sample(pool, rng.randrange(9)), [rng.choice(pool) for _ in range(6)]
        rows = spark.createDataFrame([(str(k), "p", n) for k, n in enumerate(there)] + [("z", "q", "a (1).txt")], "id string, parentId string, name string")
        assert tree.free_names(rows, "p", wanted, []) == unique_names(wanted, there), (there, wanted)


def test_repaired_names_are_free(spark):
    names = ["s.txt"] * 4 + ["s (2).txt"] * 2 + ["s (1)", "t"] * 2 + ["u"]
    rows = spark.createDataFrame([(f"{k:02}", "p", n, k) for k, n in enumerate(names)], "id string, parentId string, name string, modif long")
    got = {r.id: r.name for r in tree.repaired_names(rows, "p").collect()}
    assert len(set(got.values())) == len(names)
    assert all(got[f"{k:02}"] == n for k, n in enumerate(names) if names.index(n) == k)
    assert {got["01"], got["02"], got["03"], got["05"]} == {"s (1).txt", "s (3).txt", "s (4).txt", "s (5).txt"}


def test_roll_ups_of_random_trees(spark):
    import random

    rng = random.Random(2)
    parents = {f"n{k}": (f"n{rng.randrange(max(0, k - 4), k)}" if k and rng.random() < 0.95 else "/") for k in range(120)}
    folders = set(parents.values())
    df = spark.createDataFrame([(n, p, n in folders, int(n[1:]), n) for n, p in parents.items()], "id string, parentId string, isDir boolean, size long, index string")
    want = {}
    for n in parents:
        at = parents[n]
        while True:
            t = want.setdefault(at, [0, 0, 0])
            t[0], t[1], t[2] = t[0] + 1, t[1] + (n not in folders), t[2] + int(n[1:])
            if at == "/":
                break
            at = parents[at]
    got = {r.id: (r.ctotal, r.cftotal or 0, r.csize or 0) for r in tree.roll_ups(df).collect()}
    assert got == {k: tuple(v) for k, v in want.items()}
    assert {r.id: r.childLastIndex for r in tree.roll_ups(df).collect()} == {p: max(n for n in parents if parents[n] == p) for p in folders}
    loop = df.union(spark.createDataFrame([("x", "y", True, 0, ""), ("y", "x", True, 0, "")], df.schema))
    with pytest.raises(QueryError):
        tree.roll_ups(loop)


def test_deep_trees(spark):
    n = 130
    rows = [(f"n{k}", f"n{k - 1}" if k else "/", k < n - 1, 1) for k in range(n)]
    df = spark.createDataFrame(rows, "id string, parentId string, isDir boolean, size long").withColumn("index", F.lit("")).coalesce(1)
    top = tree.roll_ups(df).where("id = 'n0'").first()
    assert (top.ctotal, top.cftotal, top.csize) == (n - 1, 1, n - 1)


def test_stored_rows_are_typed(spark):
    rows = writes.rows_of(spark, [{"id": 1, "a": 1}, {"a": 2.5, "o": {"k": None}}, {"o": {"k": [1], "l": "x"}}], spark.createDataFrame([], "id string, a double").schema).collect()
    assert rows[0].id == "1" and rows[0].a == 1.0 and rows[2].o.k == [1] and rows[1].o.l is None
