import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm.percentiles import Universe, combine_parts, compress, group_percentiles, local_digests, merge_digests, read_percentiles


def rank_error(values, percent, got):
    rank = max(1, math.ceil(percent * len(values) / 100 - 1e-9))
    below, upto = sum(v < got for v in values), sum(v <= got for v in values)
    return max(0, below + 1 - rank, rank - upto)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1023), min_size=1, max_size=400), st.integers(1, 20))
def test_compress_keeps_counts_and_bounds_ranks(values, parts):
    bits, eps = 10, 0.2
    group, node, count = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    for k in range(parts):  # digests of parts, compressed and merged one after the other
        own = np.array(values[k::parts], np.int64) + 1024
        group, node, count = (np.concatenate(x) for x in ((group, np.zeros(len(own), np.int64)), (node, own), (count, np.ones(len(own), np.int64))))
        group, node, count = compress(group, node, count, bits, eps)
    assert count.sum() == len(values)
    assert len(set(node.tolist())) == len(node)
    depth = np.floor(np.log2(node)).astype(int)
    last = ((node + 1) << (bits - depth)) - 1 - 1024
    order = np.lexsort((bits - depth, last))
    upto = np.cumsum(count[order])
    for percent in (1, 25, 50, 75, 99):
        rank = max(1, math.ceil(percent * len(values) / 100 - 1e-9))
        got = last[order][np.searchsorted(upto, rank)]
        assert rank_error(values, percent, got) <= eps * len(values)


@pytest.mark.parametrize("eps", [0.005, 0.2])
def test_groups_days_nulls(spark, eps):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.randrange(30), rng.choice([None, -1, 999, rng.randrange(20, 70), 2**31 - 1, -(2**31)]), 1, "x") for _ in range(3000)]
    rows += rows[:100] + [("c", 1, None, 1, "x"), ("d", None, 5, 1, "x")]
    df = spark.createDataFrame(rows, "office string, day int, v int, n int, node string").repartition(3)
    held = defaultdict(list)
    for o, _, v, *_ in rows:
        if v is not None:
            held[o].append(v)
    df = df.drop("n", "node")
    got = group_percentiles(df, keys=["office"], part="day", value="v", percents=[1, 25, 50, 75, 99], eps=eps).collect()
    assert {(r["office"], r["percent"]) for r in got} == {(o, float(p)) for o in held for p in (1, 25, 50, 75, 99)}
    for r in got:
        assert r["n"] == len(held[r["office"]])
        assert rank_error(held[r["office"]], r["percent"], r["value"]) <= (eps * r["n"] if r["n"] >= 32 / eps else 0)


def test_daily_digests_combine(spark):
    df = spark.range(20_000).selectExpr("id % 7 as day", "cast(pow(id % 1000, 2) as double) as v", "1 as k")
    universe = Universe(bits=16, low=0.0, width=16.0)
    daily = merge_digests(local_digests(df, ["k", "day"], "v", universe, 0.02), ["k", "day"], universe, 0.02)
    assert daily.groupBy("day").count().agg({"count": "max"}).first()[0] < 3 * 16 / 0.02
    whole = read_percentiles(combine_parts(daily, ["k"], "day", universe, 0.02), ["k"], [50.0], universe).first()
    assert whole["n"] == 20_000 and abs(whole["value"] ** 0.5 - 500) < 0.02 * 1000 + 2


def test_empty_and_nan(spark):
    df = spark.createDataFrame([("a", 1, float("nan")), ("a", 1, None)], "o string, day int, v double")
    assert group_percentiles(df, keys=["o"], part="day", value="v", percents=[50.0]).count() == 0
    assert group_percentiles(df.limit(0), keys=["o"], part="day", value="v", percents=[50.0]).count() == 0
