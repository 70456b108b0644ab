"""Updates and write verbs against the evaluator, and as states after."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fernbase.errors import QueryError
from fernbase.functions.documents import updated
from fernbase.operators import writes

SCHEMA = "id string, n int, x double, s string, tags array<string>, info struct<a: int, b: struct<c: int>>, items array<struct<k: string, v: int>>"
DOCS = [
    {"id": "1", "n": 5, "x": 2.0, "s": "m", "tags": ["a", "b", "a"], "info": {"a": 1, "b": {"c": 2}}, "items": [{"k": "p", "v": 1}, {"k": "q", "v": 2}]},
    {"id": "2", "tags": []},
    {"id": "3", "n": -1, "s": "z", "tags": ["c"], "info": {"a": 7}, "items": []},
]
UPDATES = [
    {"$set": {"n": 9, "info.b.c": 4}},
    {"$set": {"info": {"a": 3}}},
    {"$set": {"tags": ["q"], "s": None}},
    {"$unset": {"n": "", "info.a": ""}},
    {"$unset": ["s"]},
    {"$inc": {"n": 3, "x": 0.5}},
    {"$mul": {"n": 4, "x": 2}},
    {"$min": {"n": 0, "s": "n"}},
    {"$max": {"n": 0, "s": "n"}},
    {"$rename": {"s": "label"}},
    {"$push": {"tags": "z"}},
    {"$push": {"tags": {"$each": ["y", "z"], "$slice": 2}}},
    {"$push": {"tags": {"$each": ["y", "z"], "$slice": -3}}},
    {"$push": {"tags": {"$each": ["y"], "$position": 0, "$slice": 0}}},
    {"$push": {"tags": {"$each": ["y", "z"], "$position": 1}}},
    {"$push": {"tags": {"$each": ["y"], "$position": -1}}},
    {"$push": {"tags": {"$each": [], "$slice": 1}}},
    {"$addToSet": {"tags": "a"}},
    {"$addToSet": {"tags": {"$each": ["q", "b", "q"]}}},
    {"$pop": {"tags": 1}},
    {"$pop": {"tags": -1}},
    {"$pull": {"tags": "a"}},
    {"$pull": {"tags": {"$in": ["a", "c"]}}},
    {"$pull": {"tags": {"$gt": "a"}}},
    {"$pull": {"items": {"k": "p"}}},
    {"$set": {"n": 1}, "$inc": {"n": 1}, "$max": {"n": 9}},
    {"$set": {"fresh.deep": 5}},
]


def bare(value):
    """Without nulls in objects, and without objects that hold nothing: null and missing are one in typed columns."""
    if isinstance(value, dict):
        out = {k: bare(v) for k, v in value.items()}
        return {k: v for k, v in out.items() if v is not None and v != {}}
    return [bare(x) for x in value] if isinstance(value, list) else value


@pytest.fixture(scope="module")
def df(spark):
    return writes.rows_of(spark, DOCS, spark.createDataFrame([], SCHEMA).schema)


def state(df):
    return {r.id: bare(r.asDict(recursive=True)) for r in df.collect()}


@pytest.mark.parametrize("op", UPDATES, ids=str)
def test_updates_like_the_evaluator(df, op):
    after = state(writes.update_many(df, {}, op))
    assert after == {d["id"]: bare(updated(d, op)) for d in DOCS}


def test_only_matching_rows_change(df):
    after = writes.update_many(df, {"n": {"$gt": 0}}, {"$set": {"new": 1}})
    assert {i: d.get("new") for i, d in state(after).items()} == {"1": 1, "2": None, "3": None}
    assert writes.changes(df, after).first().asDict() == {"inserted": 0, "removed": 0, "modified": 1}


def test_push_leaves_what_is_no_array(df):
    assert state(writes.update_many(df, {}, {"$push": {"n": 3}, "$addToSet": {"s": "x"}, "$pop": {"n": 1}})) == state(df)


@pytest.mark.parametrize("op", [{}, {"$foo": {}}, {"n": 1}, {"$inc": {"n": "x"}}])
def test_refused(df, op):
    with pytest.raises(QueryError):
        writes.update_many(df, {}, op).collect()


def test_update_one_and_bulk(df):
    after = state(writes.update_one(df, {"n": {"$exists": True}}, {"$set": {"s": "!"}}, sort=["-n"]))
    assert {i for i, d in after.items() if d.get("s") == "!"} == {"1"}
    items = [{"filter": {"n": -1}, "update": {"$set": {"n": 50}}}, {"filter": {"n": 50}, "update": {"$inc": {"n": 1}}}, {"filter": {"id": "new"}, "update": {"$set": {"n": 8}}, "options": {"upsert": True}}]
    after = state(writes.bulk_update(df, items))
    assert after["3"]["n"] == 51 and after["new"]["n"] == 8 and len(after) == 4


def test_upsert_uses_filter_and_insert_values(df):
    after = state(writes.upsert_one(df, {"id": "9", "s": "q", "n": {"$gt": 100}}, {"$inc": {"n": 2}, "$setOnInsert": {"x": 1.5}, "$push": {"tags": "t"}}))
    assert after["9"] == {"id": "9", "s": "q", "n": 2, "x": 1.5, "tags": ["t"]}
    assert state(writes.upsert_one(df, {"id": "1"}, {"$setOnInsert": {"x": 9.0}, "$set": {"n": 6}}))["1"]["x"] == 2.0


def test_set_many_kinds(spark, df):
    new = writes.rows_of(spark, [{"id": "1", "n": 1}, {"id": "1", "n": 2, "tags": ["z", "a"]}, {"id": "8", "s": "v"}], df.select("id", "n", "s", "tags").schema)
    assert state(writes.set_many(df, new))["1"] | {"tags": 0} == bare(DOCS[0]) | {"n": 2, "tags": 0}
    assert state(writes.set_many(df, new, overwrite=True))["1"] == {"id": "1", "n": 2, "tags": ["z", "a"]}
    assert state(writes.set_many(df, new, merge=True))["1"]["tags"] == ["a", "b", "a", "z"]
    assert set(state(writes.set_many(df, new, update_only=True))) == {"1", "2", "3"}
    assert state(writes.set_many(df, new, insert_only=True))["1"]["n"] == 5
    assert state(writes.set_many(df, new, set_on_insert={"s": "no", "n": 4}))["8"] == {"id": "8", "s": "v", "n": 4}


def test_merge_of_objects(spark, df):
    new = writes.rows_of(spark, [{"id": "1", "info": {"b": {"c": 9}}}], df.select("id", "info").schema)
    assert state(writes.set_many(df, new, merge=True))["1"]["info"] == {"a": 1, "b": {"c": 9}}
    assert state(writes.set_many(df, new))["1"]["info"] == {"b": {"c": 9}}


def test_insert_skips_ids_and_unique_keys(spark):
    have = writes.rows_of(spark, [{"id": "1", "mail": "a", "_id": 1}, {"id": "2", "mail": None, "_id": 2}], spark.createDataFrame([], "_id long, id string, mail string").schema)
    have = have.withColumn("_id", F.col("id").cast("long"))
    new = writes.rows_of(spark, [{"id": "1", "mail": "x"}, {"id": "3", "mail": "a"}, {"id": "4", "mail": "b"}, {"id": "5", "mail": "b"}, {"id": "6"}, {"mail": "c"}])
    out = writes.insert_many(have, new.coalesce(1), unique=[["mail"]]).collect()
    assert {r.id for r in out if r.id and len(r.id) < 9} == {"1", "2", "4", "6"} and sum(len(r.id) > 9 for r in out) == 1
    assert len({r._id for r in out}) == 5 and min(r._id for r in out if r.id not in ("1", "2")) > 2


def test_clock_and_soft_delete(df):
    now = dt.datetime(2024, 5, 6)
    gone = writes.soft_delete_many(df, {"tags": "a"}, now)
    rows = {r.id: r for r in gone.collect()}
    assert rows["1"]._isDeleted and rows["1"]._deleteDate == now and rows["2"]._isDeleted is None
    assert sorted(state(writes.delete_many(df, {"n": {"$gt": 0}}))) == ["2", "3"]
    assert sorted(state(writes.delete_one(df, {}, sort=["-n"]))) == ["2", "3"]


def test_paths_and_nulls_of_set_many(spark, df):
    """A key with dots changes what lies at its path and nothing beside it; a null empties the field."""
    docs = [{"id": "1", "info.a": 8}, {"id": "2", "info.b.c": 6, "n": 3}, {"id": "3", "info.a": None, "s": None}, {"id": "9", "info.b.c": 1}]
    out = {r.id: r for r in writes.set_many(df, writes.patch_rows(spark, docs, df.schema)).collect()}
    assert out["1"].info.asDict(recursive=True) == {"a": 8, "b": {"c": 2}} and out["1"].n == 5
    assert out["2"].info.asDict(recursive=True) == {"a": None, "b": {"c": 6}} and out["2"].n == 3 and out["2"].tags == []
    assert out["3"].info is None or out["3"].info.a is None
    assert out["3"].s is None and out["3"].n == -1
    assert out["9"].info.b.c == 1
    assert writes.rows_of(spark, [{"id": "1", "a.b": 5, "a": {"c": 1}}]).first().a.asDict() == {"b": 5, "c": 1}


def test_bulk_updates_one_after_the_other(spark):
    """Random lists of items by id and by filter against a plain fold over dictionaries."""
    import random

    rng = random.Random(8)
    start = [{"id": str(k), "n": k, "s": "abc"[k % 3]} for k in range(6)]
    df = spark.createDataFrame([(d["id"], d["n"], d["s"]) for d in start], "id string, n long, s string")
    for _ in range(4):
        items, rows = [], [dict(d) for d in start]
        for _ in range(9):
            by = {"id": str(rng.randrange(8))} if rng.random() < 0.8 else {"s": rng.choice("abcz")}
            op = rng.choice([{"$inc": {"n": rng.randrange(5)}}, {"$set": {"s": rng.choice("abc")}}, {"$mul": {"n": 2}, "$set": {"s": "z"}}, {"$max": {"n": 4}}])
            items.append({"filter": by, "update": op, "options": {"upsert": "id" in by and rng.random() < 0.4}})
        for item in items:
            key, value = next(iter(item["filter"].items()))
            hit = sorted((r for r in rows if r.get(key) == value), key=lambda r: r["id"])
            if hit:
                fresh = updated(hit[0], item["update"])
                hit[0].clear()
                hit[0].update(fresh)
            elif item["options"]["upsert"]:
                rows.append(writes.upsert_row(item["filter"], item["update"]))
        got = sorted((r.id, r.n, r.s) for r in writes.bulk_update(df, items).collect())
        assert got == sorted((r["id"], r.get("n"), r.get("s")) for r in rows), items


def test_bulk_updates_by_id_are_one_join(spark):
    df = spark.createDataFrame([(str(k), k) for k in range(50)], "id string, n long")
    items = [{"filter": {"id": str(k)}, "update": {"$inc": {"n": k % 3}}} for k in range(50)] * 2
    plan = writes.bulk_update(df, items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert sorted(r.n for r in writes.bulk_update(df, items).collect()) == sorted(k + 2 * (k % 3) for k in range(50))
