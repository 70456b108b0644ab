"""Sorting, paging, projections and lookups."""

import pytest
from pyspark.sql import functions as F

from fernbase.errors import QueryError
from fernbase.operators import find
from fernbase.operators.lookup import Lookup, lookup, lookup_all


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i + 1, str(i), f"n{i}", 20 + i % 5 if i % 7 else None, [f"t{i % 3}"], (i % 2 == 0, i)) for i in range(60)]
    return spark.createDataFrame(rows, "_id long, id string, name string, age int, tags array<string>, meta struct<active: boolean, n: int>").cache()


def test_order_of_nulls_and_ties(people):
    up = [(r.age, r.name) for r in find.find_many(people, {}, sort=["age"]).collect()]
    assert up[0][0] is None and up == sorted(up, key=lambda x: (x[0] is not None, x[0] or 0, int(x[1][1:])))
    down = [r.age for r in find.find_many(people, {}, sort={"age": -1}).collect()]
    assert down[-1] is None and down[0] == 24
    assert [r.name for r in find.find_many(people, {}, limit=5).collect()] == [f"n{i}" for i in range(5)]


def test_numeric_and_case_order(spark):
    df = spark.createDataFrame([("f10",), ("f2",), ("F3",), ("f01",)], "s string")
    assert [r.s for r in find.find_many(df, {}, sort=["s"], numeric_ordering=True, case_sensitive=False).collect()] == ["f01", "f2", "F3", "f10"]


def test_long_numbers_in_order(spark):
    """Runs of digits of any length, leading zeros aside."""
    names = ["v1" + "0" * k for k in range(25)] + ["v007", "v9", "w", "v"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = [r.s for r in find.find_many(df, {}, sort=["s"], numeric_ordering=True).collect()]
    assert got == sorted(names, key=lambda n: (n[0], int(n[1:] or -1)))


def test_lists_are_in_insertion_order(people):
    mixed = people.repartition(7, "name")
    rows: list = []
    find.for_each(mixed, {"age": {"$ne": 22}}, lambda r, i: rows.append((i, r.id)))
    assert rows == list(enumerate(r.id for r in find.find_many(people, {"age": {"$ne": 22}}, sort=["_id"]).collect()))
    batches: list = []
    find.each_batch(mixed, {}, lambda some, stop, k: batches.append([r.id for r in some]), page_size=9)
    assert sum(batches, []) == [str(i) for i in range(60)]


def test_cursors_without_insertion_numbers_go_by_id(people):
    rows, seen, cursor = people.drop("_id"), [], None
    while True:
        page = find.list_paging_by_cursor(rows, {}, sort_key="age", cursor=cursor, page_size=7)
        seen += [r.id for r in page.rows]
        if page.next_cursor is None:
            break
        cursor = page.next_cursor
    assert sorted(seen) == sorted(r.id for r in rows.collect())


def test_explain_gives_reasons_and_times(people):
    report = find.explain(people, {"tags": "t1", "none": 3}, analyze=True)
    assert report["rows"] == 0 and report["run_ms"] > 0 and {r.split(":")[0] for r in report["reasons"]} == {"tags", "none"}


def test_pages_join_up(people):
    every = [r.id for r in find.find_many(people, {"age": {"$ne": 22}}, sort=["-age", "id"]).collect()]
    paged, k = [], 1
    while True:
        page = find.list_paging(people, {"age": {"$ne": 22}}, sort=["-age", "id"], page_index=k, page_size=7, get_total=k == 1)
        paged += [r.id for r in page.rows]
        if k == 1:
            assert page.total == len(every)
        if not page.has_next:
            break
        k += 1
    assert paged == every


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("key", ["_id", "age", "meta.n"])
def test_cursors_join_up_over_ties_and_nulls(people, key, descending):
    seen, cursor = [], None
    while True:
        page = find.list_paging_by_cursor(people, {}, cursor=cursor, sort_key=key, descending=descending, page_size=9, projection=["id"])
        seen += [r.id for r in page.rows]
        assert page.rows[0].asDict().keys() == {"id"}
        if not page.has_next:
            break
        cursor = page.next_cursor
    assert len(seen) == 60 and len(set(seen)) == 60


def test_cursor_refuses_its_key(people):
    with pytest.raises(QueryError):
        find.cursor_frame(people, {"age": 1}, sort_key="age")


def test_bounds(people):
    for bad in ({"limit": -1}, {"offset": 1.5}, {"limit": True}):
        with pytest.raises(QueryError):
            find.find_many(people, {}, **bad)
    assert find.find_many(people, {}, limit=0).count() == 60
    plan = find.find_many(people, {}, sort=["age"], limit=3, offset=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_projections(people):
    cols = lambda p: find.find_many(people, {"id": "3"}, projection=p).columns
    assert cols(None) == ["id", "name", "age", "tags", "meta"]
    assert cols(["id", "age"]) == cols({"id": 1, "age": True}) == ["id", "age"]
    assert cols({"age": 0, "tags": -1, "meta": False}) == ["id", "name"]
    assert cols({"_id": 1}) == ["_id"] and "_id" in cols({"_id": 1, "id": 1})
    assert find.find_many(people, {"id": "3"}, projection=["meta.n"]).first().asDict(True) == {"meta": {"n": 3}}
    assert find.find_many(people, {"id": "3"}, projection={"meta.n": 0}).first().meta.asDict() == {"active": False}
    with pytest.raises(QueryError):
        find.project(people, {"age": 1, "name": 0})


def test_batches_and_each(people):
    sizes = []
    find.each_batch(people, {}, lambda rows, stop, n: (sizes.append(len(rows)), stop() if n == 3 else None), page_size=25)
    assert sizes == [25, 25, 10]
    names = []
    find.each_batch(people, {}, lambda rows, stop, n: (names.append(n), stop()), page_size=10)
    assert names == [1]
    seen = []
    find.for_each(people, {"age": 20}, lambda row, i: seen.append((i, row.age)))
    assert [i for i, _ in seen] == list(range(len(seen))) and {a for _, a in seen} == {20}


@pytest.fixture(scope="module")
def tables(spark):
    users = spark.createDataFrame([("u1", "d1", ["c2", "c1", "c2", "zz"]), ("u2", None, []), ("u3", "zz", None)], "id string, dep string, cats array<string>")
    deps = spark.createDataFrame([(1, "d1", "old"), (2, "d1", "new"), (3, "d2", "x")], "_id long, id string, name string")
    cats = spark.createDataFrame([("c1", "one"), ("c2", "two")], "id string, name string")
    return users, deps, cats


def test_lookups(tables):
    users, deps, cats = tables
    one = {r.id: r for r in lookup(users, Lookup(deps, "dep", "id", "d")).collect()}
    assert one["u1"].d.name == "new" and one["u2"].d is None and one["u3"].d is None and one["u3"].dep == "zz"
    many = {r.id: r.cats for r in lookup(users, Lookup(cats, "cats", "id")).collect()}
    assert [c.name for c in many["u1"]] == ["two", "one", "two"] and many["u2"] == [] and many["u3"] is None
    both = {r.id: r for r in lookup_all(users, [Lookup(deps, "dep", "id", projection=["name"]), Lookup(cats, "cats", "id", "c", {"id": 0})]).collect()}
    assert both["u1"].dep.asDict() == {"name": "new"} and both["u1"].dep_key == "d1" and both["u3"].dep_key == "zz"
    assert [c.asDict() for c in both["u1"].c] == [{"name": n} for n in ("two", "one", "two")] and both["u1"].cats[0] == "c2"


def test_lookup_is_strict_in_types(spark, tables):
    users = spark.createDataFrame([(1, "1")], "k int, id string")
    texts = spark.createDataFrame([("1", "x")], "id string, v string")
    assert lookup(users, Lookup(texts, "k", "id", "t")).first().t is None


def test_pages_with_lookups(people, spark):
    names = spark.createDataFrame([(f"t{k}", k * 10) for k in range(3)], "id string, w int")
    page = find.list_paging(people, {}, sort=["-name"], page_size=4, joins=Lookup(names, "tags", "id", "found"))
    assert len(page.rows) == 4 and page.rows[0].name == "n9" and page.rows[0].found[0].w == (9 % 3) * 10


def test_by_ids(people, spark):
    ids = people.where(F.col("age") == 21).select("id")
    assert find.by_ids(people, ids).count() == ids.count()
