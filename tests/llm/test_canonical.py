import random
import re

import pytest

from netloom.llm.canonical import CALL_EDGE, Leaf, Node, collapse

SCHEMA = "row_id long, layer string, node1 string, node2 string, value double, id string, h1 long, form string"


@pytest.mark.parametrize("hot_rows", [3, 100_000])
def test_against_brute_force(spark, hot_rows):
    rng = random.Random(4)
    spell = lambda x: rng.choice([x, x.lower(), f"({x})", x.replace("-", " "), f"“{x}”", x[0] + "." + x[1:], f"\t{x}… "])
    rows = []
    for i in range(500):
        a, b = f"Kv-{rng.randrange(5)}", f"H-{rng.randrange(5)}"
        pair = [spell(a), spell(b)]
        rng.shuffle(pair)
        rows.append((i, rng.choice(["x", "y", None]), *pair, rng.choice([1.0, 2.5, None, 0.0, -0.0]), "q", 1, "z"))
    rows += [(600 + i, "x", *p, 1.0, "q", 1, "z") for i, p in enumerate([(None, "a"), ("a", None), ("--", ""), ("", "…"), ("ab", "c"), ("a", "bc"), ("é1", "É1"), ("x" * 100_000, "y"), ("Y", "x" * 100_000)])]
    rows += [rows[0], (None, *rows[0][1:])]
    norm = lambda x: re.sub(r"[\W_]", "", x).lower()
    groups = {}
    for i, layer, a, b, v, *_ in rows:
        if None not in (i, a, b):
            groups.setdefault((layer, v, *sorted((norm(a), norm(b)))), []).append(i)
    made, members = collapse(spark.createDataFrame(rows, SCHEMA), CALL_EDGE, id="row_id", required=["node1", "node2"], hot_rows=hot_rows)
    assert sorted((r["first_id"], r["copies"]) for r in made.collect()) == sorted((min(g), len(g)) for g in groups.values())
    assert sorted(tuple(r) for r in members.collect()) == sorted((min(g), i) for g in groups.values() if len(g) > 1 for i in g)


def test_structure_matters(spark):
    df = spark.createDataFrame([(1, "a", "b", "c"), (2, "b", "a", "c"), (3, "c", "b", "a"), (4, "a,b", "", "c"), (5, "a", ",b", "c")], "i long, x string, y string, z string")
    count = lambda tree: collapse(df, tree, id="i", required=[])[0].count()
    leaves = (Leaf("x"), Leaf("y"), Leaf("z"))
    assert count(Node(leaves)) == 5 and count(Node(leaves, ordered=False)) == 3
    assert count(Node((Node(leaves[:2], ordered=False), leaves[2]))) == 4
    assert collapse(df.limit(0), Node(leaves), id="i", required=[])[1].count() == 0
