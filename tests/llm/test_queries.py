import glob
import math
import os

import duckdb
import pytest

from netloom.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def canon(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark):
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    got, want = QUERIES[name](spark, FOLDER), db.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda rows: sorted(str([canon(x) for x in r]) for r in rows)
    assert key(got.select(*names).collect()) == key(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(name, spark):
    assert QUERIES[name](spark, FOLDER).columns


def test_all_pairs_are_not_cut(spark, tmp_path):
    rows = [("l", f"h{k}", n) for k, n in ((0, 1), (0, 2), (1, 1), (2, 1), (3, 2), (4, 2))]
    spark.createDataFrame(rows, "layer string, affiliation string, node long").write.parquet(f"{tmp_path}/affiliations.parquet")
    got = [(r["node_1"], r["node_2"], r["shared"], round(r["lift"], 3)) for r in QUERIES["p2_all_pairs"](spark, str(tmp_path)).collect()]
    assert got == [(1, 2, 1, 0.556)]
