"""Every query with SQL against DuckDB on the same tables."""

import decimal
import math

import duckdb
import pytest

from parcelloom.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 9) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    ours = QUERIES[name](spark, DIR)
    theirs = duck.sql(SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    order = sorted(ours.columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in ours.collect()), key=str)
    at = [theirs.columns.index(c) for c in order]
    b = sorted((tuple(plain(r[i]) for i in at) for r in theirs.fetchall()), key=str)
    assert a == b and (a or name.endswith("empty"))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("search_")))
def test_searches_keep_units_and_contiguity(spark, name):
    rows = QUERIES[name](spark, DIR).collect()
    assert len(rows) == 4
    assert all(r["units"] == 150 and r["contiguous"] and r["districts"] == 6 for r in rows)


LARGER = "/root/testdata/sf0.01"


def test_all_events_are_parsed(spark):
    # more events than the ids below 5000
    rows = QUERIES["log_parse"](spark, LARGER).collect()
    events = {r["event_id"]: r["value"] for r in spark.read.parquet(f"{LARGER}/events.parquet").collect()}
    assert len(rows) == len(events) > 5000
    assert all(abs(r["obj"] - events[r["iter"]]) <= 0.00501 for r in rows)


def test_every_unit_is_looked_up(spark):
    rows = {r["pid"]: r["idx"] for r in QUERIES["unit_at"](spark, LARGER).collect()}
    assert rows == {i: -1 if i % 4 == 0 else i for i in range(spark.read.parquet(f"{LARGER}/customer.parquet").count())}


@pytest.mark.parametrize("name", ["district_hulls", "block_outlines_with_holes", "block_enclaves"])
def test_outlines_grow_with_the_map(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{LARGER}/{t}.parquet'")
    theirs = con.sql(SQL[name])
    ours = QUERIES[name](spark, LARGER).select(*theirs.columns).collect()
    assert sorted(tuple(map(plain, r)) for r in ours) == sorted(tuple(map(plain, r)) for r in theirs.fetchall())
    assert len(ours) == (25 if name == "district_hulls" else 49)
