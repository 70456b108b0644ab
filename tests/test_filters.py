"""Compiled filters against the evaluator of plain documents, on fixtures and on random documents and filters."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fernbase.errors import QueryError
from fernbase.functions.documents import matches
from fernbase.operators import find
from fernbase.plans import filters

SCHEMA = """id string, n int, x double, s string, b boolean, t timestamp, tags array<string>, nums array<int>, matrix array<array<int>>,
  info struct<age: int, address: struct<city: string, zip: string>>, items array<struct<k: string, v: int, sub: array<int>>>"""
T0 = dt.datetime(2024, 1, 1)
DOCS = [
    {"id": "1", "n": 1, "x": 1.5, "s": "apple", "b": True, "t": T0, "tags": ["a", "b"], "nums": [1, 2], "matrix": [[1, 2], [3]], "info": {"age": 3, "address": {"city": "X", "zip": "1"}}, "items": [{"k": "p", "v": 1, "sub": [1, 2]}, {"k": "q", "v": 5}]},
    {"id": "2", "n": 0, "x": float("nan"), "s": "", "b": False, "tags": [], "nums": [], "matrix": [], "items": []},
    {"id": "3", "x": float("inf"), "s": "a%b_c", "tags": ["a", None], "nums": [5], "matrix": [[1, 2]], "info": {"age": None, "address": {"city": "Y", "zip": None}}, "items": [{"k": "p", "v": 9}, {"k": None, "v": 1, "sub": []}]},
    {"id": "4", "n": -7, "x": -0.0, "s": "line\nbreak", "b": True, "t": T0 + dt.timedelta(days=9), "tags": ["red"], "nums": [7, None, 7]},
    {"id": "5"},
    {"id": "10", "n": 7, "s": "Apple pie", "tags": ["b", "a"], "info": {"age": 40, "address": None}},
]


def bare(value):
    """Without nulls in objects: a typed column cannot tell them from missing fields."""
    if isinstance(value, dict):
        return {k: bare(v) for k, v in value.items() if v is not None}
    return [bare(x) for x in value] if isinstance(value, list) else value


@pytest.fixture(scope="module")
def df(spark):
    def fit(v, kind):
        if v is None:
            return None
        if hasattr(kind, "fields"):
            return tuple(fit(v.get(f.name), f.dataType) for f in kind.fields)
        return [fit(x, kind.elementType) for x in v] if hasattr(kind, "elementType") else v

    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(SCHEMA)
    return spark.createDataFrame([fit(d, schema) for d in DOCS], schema).cache()


def got(df, filter_):
    return sorted(r.id for r in df.filter(filters.compile_filter(filter_, df.schema)).select("id").collect())


def want(filter_):
    return sorted(d["id"] for d in DOCS if matches(bare(d), filter_))


FILTERS = [
    {},
    {"n": 1},
    {"n": 1.0},
    {"n": "1"},
    {"b": 1},
    {"b": True},
    {"n": None},
    {"s": {"$ne": "apple"}},
    {"n": {"$ne": None}},
    {"n": {"$gt": 0, "$lt": 7}},
    {"x": {"$gte": 0}},
    {"x": {"$not": {"$gt": 1}}},
    {"x": {"$lt": 5}},
    {"n": {"$gt": "0"}},
    {"n": {"$not": {"$gt": "0"}}},
    {"s": {"$lte": "apple"}},
    {"t": {"$gt": T0}},
    {"t": {"$lte": T0}},
    {"b": {"$lt": True}},
    {"n": {"$in": [1, 7, "x"]}},
    {"n": {"$nin": [1, 7]}},
    {"n": {"$in": []}},
    {"n": {"$nin": []}},
    {"n": {"$in": 3}},
    {"tags": "a"},
    {"tags": ["a", "b"]},
    {"tags": []},
    {"tags": {"$eq": ["b", "a"]}},
    {"tags": {"$ne": "a"}},
    {"tags": {"$in": ["red", "b"]}},
    {"tags": {"$nin": ["red", "b"]}},
    {"nums": {"$gt": 4}},
    {"nums": {"$not": {"$gt": 4}}},
    {"nums": 7.0},
    {"matrix": [1, 2]},
    {"matrix": [[1, 2], [3]]},
    {"matrix": {"$eq": [1, 2]}},
    {"tags": {"$size": 2}},
    {"tags": {"$size": {"$gte": 1}}},
    {"tags": {"$not": {"$size": 2}}},
    {"n": {"$size": 1}},
    {"tags": {"$all": ["a", "b"]}},
    {"tags": {"$all": []}},
    {"n": {"$all": [1]}},
    {"tags": {"$exists": True}},
    {"n": {"$exists": False}},
    {"no.such": {"$exists": False}},
    {"no": None},
    {"no": {"$ne": 1}},
    {"s": {"$regex": "^a"}},
    {"s": {"$not": {"$regex": "pp"}}},
    {"n": {"$regex": "1"}},
    {"tags": {"$regex": "^r"}},
    {"s": {"$like": "a%"}},
    {"s": {"$like": "a%b_c"}},
    {"s": {"$like": "line%"}},
    {"s": {"$like": "%b_c"}},
    {"info.age": {"$gte": 3}},
    {"info.address.city": "Y"},
    {"info.address": {"zip": "1", "city": "X"}},
    {"info": {"age": 40}},
    {"info.address.nope": None},
    {"tags.0": "a"},
    {"nums.2": 7},
    {"items.0.sub.1": 2},
    {"items.k": "p"},
    {"items.v": {"$gt": 5}},
    {"items.sub": [1, 2]},
    {"items.k": {"$all": ["p", "q"]}},
    {"items": {"$elemMatch": {"k": "p", "v": {"$gt": 5}}}},
    {"items": {"$not": {"$elemMatch": {"k": "p", "v": {"$gt": 5}}}}},
    {"nums": {"$elemMatch": {"$gt": 1, "$lt": 5}}},
    {"items": {"k": "q", "v": 5}},
    {"$and": [{"n": {"$gte": 0}}, {"b": False}]},
    {"$and": []},
    {"$or": []},
    {"$or": [{"n": 1}, {"tags": "red"}]},
    {"$nor": [{"n": 1}, {"tags": "red"}]},
    {"$not": {"n": {"$gt": 0}}},
    {"$not": {"$or": [{"s": {"$like": "%a%"}}, {"b": True}]}},
    {"$and": {"n": 1}},
    {"id": 10},
    {"id": {"$in": [1, "2"]}},
]


@pytest.mark.parametrize("filter_", FILTERS, ids=str)
def test_like_the_evaluator(df, filter_):
    # the evaluator sees the ids as they are stored
    plain = {k: (str(v) if isinstance(v, int) else {"$in": [str(x) for x in v["$in"]]} if isinstance(v, dict) else v) if k == "id" else v for k, v in filter_.items()}
    assert got(df, filter_) == want(plain)
    rest = sorted(r.id for r in df.filter(filters.compile_not(filter_, df.schema)).select("id").collect())
    assert rest == sorted(set(d["id"] for d in DOCS) - set(want(plain)))


def some_filter(rng, depth=0):
    if depth < 3 and rng.random() < 0.35:
        op = rng.choice(["$and", "$or", "$nor", "$not"])
        return {op: some_filter(rng, depth + 1) if op == "$not" else [some_filter(rng, depth + 1) for _ in range(rng.randrange(3))]}
    path, values = rng.choice([("n", [0, 1, -7, 7, None]), ("x", [1.5, 0, -1, 99]), ("s", ["", "apple", "b"]), ("b", [True, False]), ("tags", ["a", "red", "zz"]), ("nums", [5, 7, 2]), ("info.age", [3, 40]), ("items.v", [1, 5, 9])])
    op = rng.choice(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "plain", "$not"])
    v = rng.choice(values)
    if op == "plain":
        return {path: v}
    if op in ("$in", "$nin"):
        return {path: {op: [x for x in values if x is not None and rng.random() < 0.5]}}
    if op == "$not":
        return {path: {"$not": {"$gte": v if v is not None else 1}}}
    return {path: {op: rng.random() < 0.5 if op == "$exists" else v}}


def test_random_filters(df):
    rng = random.Random(7)
    some = [some_filter(rng) for _ in range(120)]
    # a null beside values in an array path is where typed and plain documents may differ: leave those out
    some = [f for f in some if not ("None" in str(f) and "items" in str(f))]
    marks = [F.coalesce(filters.compile_filter(f, df.schema), F.lit(False)).alias(f"f{k}") for k, f in enumerate(some)]
    rows = df.select("id", *marks).collect()
    for k, f in enumerate(some):
        assert sorted(r.id for r in rows if r[f"f{k}"]) == want(f), f


def test_null_in_lists(df):
    assert got(df, {"n": {"$in": [None, 1]}}) == ["1", "3", "5"]
    assert got(df, {"n": {"$nin": [None, 1]}}) == ["10", "2", "4"]


@pytest.mark.parametrize("filter_", [{"n": {"$near": 1}}, {"$xor": []}, {"n": {"$gt": 1, "a": 2}}, {"s": {"$regex": "\\p{Script=Greek}"}}, "n"])
def test_refused(df, filter_):
    with pytest.raises(QueryError):
        filters.compile_filter(filter_, df.schema)


def test_soft_delete_view_and_inputs_stay():
    f = {"a": 1}
    assert filters.visible(f, True) == {"a": 1, "_isDeleted": {"$ne": True}} and f == {"a": 1}
    assert filters.visible({"_isDeleted": True}, True) == {"_isDeleted": True}
    assert filters.visible({"$not": {"_isDeleted": True}}, True) == {"$not": {"_isDeleted": True}}


@pytest.mark.parametrize(
    ("filter_", "pushed"),
    [
        ({"o_orderstatus": "F"}, "EqualTo(o_orderstatus,F)"),
        ({"o_orderstatus": {"$ne": "F"}}, "Or(Not(EqualTo(o_orderstatus,F)),IsNull(o_orderstatus))"),
        ({"$nor": [{"o_totalprice": {"$lt": 5.0}}]}, "Or(Or(GreaterThanOrEqual(o_totalprice,5.0),IsNull(o_totalprice))"),
        ({"o_orderstatus": {"$in": ["F", "O"]}}, "In(o_orderstatus, [F,O])"),
        ({"$or": [{"o_orderkey": 1}, {"o_custkey": 2}]}, "Or(EqualTo(o_orderkey,1),EqualTo(o_custkey,2))"),
    ],
)
def test_filters_reach_the_reader(spark, filter_, pushed):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = find.explain(orders, filter_, projection=["o_orderkey"])
    if "$nor" in filter_:
        assert any("GreaterThanOrEqual(o_totalprice,5.0)" in p for p in plan["pushed_filters"])
    else:
        assert pushed in plan["plan"]
    assert not plan["full_scan"]


def test_variant_paths(spark):
    df = spark.createDataFrame([(1, '{"a": {"k": 5}, "s": "5", "l": [1, 2]}'), (2, '{"a": {"k": null}, "s": 5}'), (3, "{}"), (4, '{"a": {"k": 70}, "s": "x"}')], "id int, j string").withColumn("v", F.parse_json("j"))
    ids = lambda f: sorted(r.id for r in find.find_many(df, f).select("id").collect())
    assert ids({"v.a.k": {"$gt": 4}}) == [1, 4] and ids({"v.s": "5"}) == [1] and ids({"v.s": 5}) == [2]
    assert ids({"v.a.k": {"$exists": True}}) == [1, 2, 4] and ids({"v.l": {"$size": 2}}) == [1]
    assert ids({"v.a.k": {"$in": [5, 70]}}) == [1, 4] and ids({"v.s": {"$regex": "x"}}) == [4]
