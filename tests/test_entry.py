"""Every query of the core with SQL gives what the SQL gives, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from netloom.plans import command_queries, data_queries, network_queries

FOLDER = "/root/testdata/sf0.001"
PARTS = (network_queries, command_queries, data_queries)
CORE = {k: f for m in PARTS for k, f in m.QUERIES.items()}
SQL = {k: x for m in PARTS for k, x in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return db


def canon(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else str(x)


def same(query, sql, spark, duck):
    got = query(spark, FOLDER)
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda rows: sorted(str([canon(x) for x in r]) for r in rows)
    assert key(got.select(*[f"`{c}`" for c in names]).collect()) == key(want.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, duck):
    same(CORE[name], SQL[name], spark, duck)


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_query_without_sql_gives_the_same_rows_again(name, spark):
    key = lambda: sorted(map(str, CORE[name](spark, FOLDER).collect()))
    first = key()
    assert first and first == key()


def test_contract(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(CORE) <= set(entry.queries())


def test_distances_have_no_limit_of_steps(spark, tmp_path):
    """A chain of 12 arcs, and one of 5 hyperedges, are followed to their ends."""
    o, j = network_queries.OUT, network_queries.JOINED
    chain = [(k, a, b, 1.0) for k, (a, b) in enumerate(zip([o, *range(101, 112)], range(101, 113)))]
    spark.createDataFrame(chain, "row_id long, `from` long, `to` long, value double").write.parquet(f"{tmp_path}/trade_edges.parquet")
    spark.createDataFrame([(0, "1", "2", None)], "row_id long, node1 string, node2 string, value double").write.parquet(f"{tmp_path}/call_edges.parquet")
    members = [("m", f"h{k}", n) for k, (a, b) in enumerate(zip([j, *range(112, 116)], range(112, 117))) for n in (a, b)]
    spark.createDataFrame(members, "layer string, affiliation string, node long").write.parquet(f"{tmp_path}/affiliations.parquet")
    far = lambda name: max(r["distance"] for r in CORE[name](spark, str(tmp_path)).collect())
    assert (far("n_distances_arcs"), far("n_distances_two_mode"), far("n_distances_all_layers")) == (12, 5, 16)
