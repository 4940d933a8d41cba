import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from netloom.operators.skew import dominant_keys, fragment_replicate_join, key_profile, plan_loads


def data(rng, n):
    pick = lambda many: rng.choice(["hot", "hot", None, *[f"a{i}" for i in range(many)]])
    return [(rng.choice(["L", "M", None]), pick(30), rng.choice([1, 1, None, *range(2, 50)]), "x", 1) for _ in range(n)]


@pytest.mark.parametrize("tasks", [1, 3, 8])
def test_profile(spark, rows, tasks):
    facts = data(random.Random(1), 900)
    facts += facts[:50]
    df = spark.createDataFrame(facts, "layer string, affiliation string, node long, bin string, shards int")
    expected, scope = Counter(), Counter(r[0] for r in facts)
    partners = {}
    for layer, a, n, *_ in facts:
        for key in ((layer, "affiliation", a, n), (layer, "node", n if n is None else str(n), a)):
            if key[2] is not None:
                expected[key[:3]] += 1
                partners.setdefault(key[:3], set()).update({key[3]} - {None})
    got = {tuple(r)[:3]: tuple(r)[3:] for r in key_profile(df, scope="layer", fields=("affiliation", "node"), tasks=tasks).collect()}
    assert got == {k: (n, len(partners[k]), scope[k[0]]) for k, n in expected.items()}
    heavy = rows(dominant_keys(df, scope="layer", fields=("affiliation", "node"), share=20, tasks=tasks))
    assert set(heavy) == {k for k, n in expected.items() if 20 * n >= scope[k[0]]}


def test_loads_are_even_though_one_key_has_a_third(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    plan = plan_loads(df, ["k"], tasks=6)
    assert max(plan.loads) < 1.3 * 30_000 / 6
    per_task = plan.fragment(df.withColumn("p", F.rand(1)), ["k"], ["p"]).groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == 6 and max(r["count"] for r in per_task) < 1.5 * 30_000 / 6


def test_join(spark, rows):
    facts = spark.range(2_000).select(F.when(F.col("id") < 900, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v"))
    side = spark.createDataFrame([(k, f"s{k}") for k in [*range(30), None, 7]], "k long, s string")
    got = fragment_replicate_join(facts, side, ["k"], tasks=5)
    assert rows(got.select("k", "v", "s")) == rows(facts.join(side.distinct(), "k").select("k", "v", "s"))


def test_empty(spark):
    df = spark.createDataFrame([], "layer string, affiliation string, node long")
    assert key_profile(df, scope="layer", fields=("affiliation", "node")).count() == 0
    assert fragment_replicate_join(df, df.select(F.col("node"), F.lit(1).alias("one")), ["node"]).count() == 0
