import random
from collections import Counter
from itertools import combinations

import pytest

from netloom.llm.cooccurrence import basket_classes, shared_baskets


def brute(rows, least, lift):
    facts = {r[:3] for r in rows if None not in r[:3]}
    baskets, counts, pairs = {}, Counter((s, i) for s, _, i in facts), Counter()
    for s, b, i in facts:
        baskets.setdefault((s, b), set()).add(i)
    n = Counter(s for s, _ in baskets)
    for (s, _), items in baskets.items():
        pairs.update((s, x, y) for x, y in combinations(sorted(items), 2))
    return {k: t for k, t in pairs.items() if t >= least and t * n[k[0]] >= lift * counts[k[0], k[1]] * counts[k[0], k[2]]}


@pytest.mark.parametrize("block", [2, 5, 1000])
@pytest.mark.parametrize("least, lift", [(1, 0.0), (3, 1.0), (6, 4.0)])
def test_against_brute_force(spark, block, least, lift):
    rng = random.Random(least)
    rows = []
    for s in "AB":
        for b in range(90):
            size = rng.choice([1, 2, 3, 4, 30])
            rows += [(s, f"b{b}", rng.randrange(60) if rng.random() < 0.8 else b % 8, "x") for _ in range(size)]
            if b % 3 == 0:
                rows += [(s, f"b{b}", i, "x") for i in (100 + b % 2, 102, 103)]  # the same basket again and again
    rows += rows[:40] + [(None, "b1", 1, "x"), ("A", None, 1, "x"), ("A", "b1", None, "x")]
    df = spark.createDataFrame(rows, "layer string, affiliation string, node long, weight string")
    got = shared_baskets(df, scope="layer", basket="affiliation", item="node", min_shared=least, lift=lift, block=block)
    assert {(r["layer"], r["item_1"], r["item_2"]): r["shared"] for r in got.collect()} == brute(rows, least, lift)


def test_equal_baskets_are_one_and_scores(spark):
    rows = [("L", b, i) for b in "pqr" for i in (1, 2)] + [("L", "s", 1), ("L", "t", 9)]
    df = spark.createDataFrame(rows, "layer string, affiliation string, node long")
    assert sorted((r["affiliation"], r["weight"]) for r in basket_classes(df, "layer", "affiliation", "node").collect()) == [("p", 3), ("s", 1), ("t", 1)]
    r = shared_baskets(df, scope="layer", basket="affiliation", item="node", min_shared=1).first()
    assert (r["shared"], r["count_1"], r["count_2"], r["baskets"]) == (3, 4, 3, 5)
    assert r["lift"] == pytest.approx(3 * 5 / 12) and r["conviction"] is None
    assert shared_baskets(df.limit(0), scope="layer", basket="affiliation", item="node", min_shared=2).count() == 0
