import random
from datetime import datetime, timedelta

import pytest

from netloom.operators.orphans import key_runs, orphan_references, orphan_report

T = datetime(2024, 1, 1)
REFS = "tab string, row_id long, ref long, at timestamp_ntz, k long, bucket int, kind int"
PARENTS = "node_id long, registered_at timestamp_ntz, deleted_at timestamp_ntz, k long, t string"


def brute(refs, parents):
    out = []
    for tab, row, ref, at, *_ in refs:
        if ref is None:
            continue
        own = [(s, e) for n, s, e, *_ in parents if n == ref and s is not None]
        if at is not None and any(s <= at and (e is None or at < e) for s, e in own):
            continue
        if all(n != ref for n, *_ in parents):
            out.append((tab, row, ref, "unknown"))
        elif at is None:
            out.append((tab, row, ref, "undated"))
        elif any(s <= at and (e is None or s < e) for s, e in own):
            out.append((tab, row, ref, "deleted"))
        else:
            out.append((tab, row, ref, "early"))
    return sorted(out)


@pytest.mark.parametrize("hot_rows", [10**6, 5])
def test_against_brute_force(spark, hot_rows):
    rng = random.Random(3)
    day = lambda: T + timedelta(days=rng.randrange(100))
    parents = []
    for n in [*range(0, 40), *range(2045, 2052), 4294967295]:
        for _ in range(rng.randrange(1, 4)):
            s = day()
            parents.append((n, s, rng.choice([None, s + timedelta(days=rng.randrange(0, 30))]), n, "x"))
    parents += parents[:9] + [(None, T, None, 1, None), (5000, None, None, 1, None), (5001, T, T, 1, None)]
    refs = [("a", i, rng.choice([7, 7, 7, *range(60), 2044, 2047, 2052, 5000, 5001, 4294967295, -3, None]), rng.choice([day(), day(), None, T]), 1, 2, 3) for i in range(400)]
    refs += refs[:20]
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), payload=["tab", "row_id"], hot_rows=hot_rows, max_hot=50)
    assert sorted((r["tab"], r["row_id"], r["ref"], r["reason"]) for r in got.collect()) == brute(refs, parents)


def test_empty_tables(spark, rows):
    refs = spark.createDataFrame([("a", 1, 5, T, 0, 0, 0)], REFS)
    none = spark.createDataFrame([], PARENTS)
    assert rows(orphan_references(refs, none, payload=["row_id"]).select("row_id", "reason")) == [(1, "unknown")]
    assert rows(orphan_references(refs.limit(0), none, payload=["row_id"])) == []


def test_runs_and_report(spark, rows):
    parents = spark.createDataFrame([(k,) for k in (1, 2, 3, 3, 7, 1023, 1024)], "n long")
    assert rows(key_runs(parents, "n").select("first", "last")) == [(1, 3), (7, 7), (1023, 1023), (1024, 1024)]
    found = orphan_references(spark.createDataFrame([("a", 1, 5, T, 0, 0, 0), ("a", 2, 5, None, 0, 0, 0)], REFS), parents.selectExpr("n node_id", "timestamp_ntz'2020-01-01' registered_at", "cast(null as timestamp_ntz) deleted_at"), payload=["tab"])
    assert rows(orphan_report(found, by=["tab"]))[1][3] == 1
