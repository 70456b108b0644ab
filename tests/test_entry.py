"""Every core query against its SQL, the driver's contract, and streams."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fernbase import queries
from fernbase.streaming import filtered

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    out = sql.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(out.columns)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [out.columns.index(c) for c in order]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in out.fetchall())


def test_write_verbs_over_whole_tables(spark, sql):
    buyers, new = sql.sql("SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)), (SELECT count(*) FROM supplier)").fetchall()[0]
    row = queries.QUERIES["write_changes"](spark, SF).first()
    assert buyers > 50 and (row.modified, row.inserted, row.removed) == (buyers, new, 0)
    for name in ("insert_skip_existing", "set_many_shallow", "set_many_overwrite", "set_many_update_only", "set_many_insert_only", "set_many_set_on_insert", "set_with_clock", "insert_unique_key"):
        ids = {r.id for r in queries.QUERIES[name](spark, SF).select("id").collect()}
        assert {str(k) for (k,) in sql.sql("SELECT c_custkey FROM customer").fetchall()} <= ids


def test_filters_and_lookups_over_whole_tables(spark, sql):
    """Every row is on one side of each filter, and every row of a lookup's or projection's table is there."""
    count = {name: queries.QUERIES[name](spark, SF).count() for name in ("filter_null", "filter_exists", "filter_in_null", "filter_nin_null", "lookup_one", "lookup_null_key", "find_exclude", "find_dotted_projection", "soft_delete_view")}
    orders, people = sql.sql("SELECT (SELECT count(*) FROM orders), (SELECT count(*) FROM customer)").fetchall()[0]
    assert count["filter_null"] + count["filter_exists"] == count["filter_in_null"] + count["filter_nin_null"] == orders
    assert count["lookup_one"] == count["lookup_null_key"] == orders
    assert count["find_exclude"] == count["find_dotted_projection"] == count["soft_delete_view"] == people


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = filtered.read(spark, SF, events.schema, "events.parquet")
    wanted = {"event_type": {"$in": ["click", "view"]}, "value": {"$gt": 1}}
    query = filtered.with_update(filtered.matching(stream, wanted), {"event_type": "view"}, {"$inc": {"value": 100}}).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path)).start()
    query.processAllAvailable()
    query.stop()
    want = events.where("event_type in ('click', 'view') and value > 1").withColumn("value", F.expr("value + if(event_type = 'view', 100, 0)"))
    assert sorted(map(tuple, spark.table("seen").select("event_id", "value").collect())) == sorted(map(tuple, want.select("event_id", "value").collect()))
    windows = filtered.counts(stream, "ts", "1 day", "1 day", wanted)
    assert windows.isStreaming and windows.columns == ["window", "n"]
