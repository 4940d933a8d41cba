import itertools
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from netloom.functions.conditions import attribute_condition
from netloom.functions.errors import Failure
from netloom.functions.tables import checkpoint_folder
from netloom.operators import generators, graph


def frame(spark, pairs, valued=None):
    return spark.createDataFrame([(a, b, float(v)) for a, b, v in (valued or [(a, b, 1.0) for a, b in pairs])], "src long, dst long, value float")


def nodes(spark, n):
    return spark.range(n).select(F.col("id").alias("node_id"))


def partition(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    order = {x: k for k, x in enumerate(sorted(set(label)))}
    return [order[x] for x in label]


@pytest.mark.parametrize("seed", range(3))
def test_components_and_distances(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(25)} | {(30 + i, 31 + i) for i in range(9)}
    got = sorted(tuple(r) for r in graph.components(nodes(spark, 42), frame(spark, pairs).select("src", "dst")).collect())
    assert got == list(enumerate(partition(42, pairs)))
    start = min(a for a, _ in pairs)
    dist, edge = {start: 0}, [start]
    while edge:
        edge = [b for b in {b for a, b in pairs if a in edge} if b not in dist]
        dist |= {b: max(dist.values()) + 1 for b in edge}
    found, _ = graph.distances(spark.createDataFrame([(start,)], "node_id long"), [graph.step_one_mode(frame(spark, pairs), True)])
    assert {r["node_id"]: r["distance"] for r in found.collect()} == dist
    far = max(dist, key=dist.get)
    assert graph.distances(spark.createDataFrame([(start,)], "node_id long"), [graph.step_one_mode(frame(spark, pairs), True)], target=far)[1] == dist[far]


@pytest.mark.parametrize("large", [1, 3, 100])
def test_two_mode_degree(spark, large):
    rng = random.Random(5)
    sets = {f"h{i}": {rng.randrange(30) for _ in range(rng.choice([1, 2, 3, 9]))} for i in range(12)}
    members = spark.createDataFrame([(h, n) for h, s in sets.items() for n in s], "hyper_name string, node_id long")
    truth = {v: len(set().union(*[s for s in sets.values() if v in s]) - {v}) for v in range(32)}
    assert {r[0]: r[1] for r in graph.two_mode_degree(nodes(spark, 32), members, large).collect()} == truth
    assert graph.two_mode_density(nodes(spark, 32), members).first()["density"] == pytest.approx(sum(truth.values()) / (32 * 31))
    two = sorted(r["node_id"] for r in graph.components(nodes(spark, 32), graph.bipartite(members)).collect())
    assert two == list(range(32))


def test_degrees_and_density(spark):
    edges = frame(spark, [(0, 1), (1, 0), (2, 2), (1, 3), (9, 1)])
    get = lambda k: [r["degree"] for r in graph.degree(nodes(spark, 4), edges, True, k).orderBy("node_id").collect()]
    assert (get("in"), get("out"), get("both")) == ([1, 2, 1, 1], [1, 2, 1, 0], [2, 4, 2, 1])
    assert [r["degree"] for r in graph.degree(nodes(spark, 4), frame(spark, [(0, 1), (2, 2)]), False).orderBy("node_id").collect()] == [1, 1, 1, 0]
    assert graph.density(nodes(spark, 4), edges, True, False).first()["density"] == 5 / 12
    for n in (0, 1):
        assert str(graph.density(nodes(spark, n), edges.limit(0), False, False).first()["density"]) == "nan"
    assert graph.components(nodes(spark, 0), edges.limit(0).select("src", "dst")).count() == 0


def test_symmetrize_is_per_pair(spark):
    arcs = frame(spark, None, [(1, 2, 4), (2, 1, 6), (1, 3, 5), (4, 4, 3), (5, 6, -2)])
    get = lambda m: {(r[0], r[1]): r[2] for r in graph.symmetrize(arcs, m, True).collect()}
    assert get("max") == {(1, 2): 6, (1, 3): 5, (4, 4): 3}
    assert get("min") == {(1, 2): 4, (4, 4): 3} and get("minnonzero") == {(1, 2): 4, (1, 3): 5, (4, 4): 3}
    assert get("average") == {(1, 2): 5, (1, 3): 2.5, (4, 4): 3} and get("sum") == {(1, 2): 10, (1, 3): 5, (4, 4): 6}
    assert get("product") == {(1, 2): 24, (4, 4): 9}
    assert {r["value"] for r in graph.symmetrize(arcs, "sum", False).collect()} == {1.0}


def test_dichotomize(spark):
    arcs = frame(spark, None, [(1, 2, 4), (2, 1, 6), (1, 3, float("nan"))])
    run = lambda *a: (sorted(tuple(r) for r in graph.dichotomize(arcs, *a)[0].collect()), graph.dichotomize(arcs, *a)[1])
    assert run("ge", 5.0, 1.0, 0.0) == ([(2, 1, 1.0)], False)
    assert run("ge", 5.0, 0.0, 0.0) == ([(2, 1, 0.0)], False)
    assert run("lt", 5.0, None, 9.0)[1] is True
    assert [r[:2] for r in run("lt", 5.0, 1.0, 0.0)[0]] == [(1, 2), (1, 3)]  # NaN comes before all numbers


@pytest.mark.parametrize(
    "cond, text, kept", [("eq", "3", [1]), ("ne", "3", [0, 2]), ("ne", "x", [0]), ("eq", "x", []), ("gt", "3", [2]), ("le", "3", [1]), ("isnull", None, [0]), ("notnull", None, [1, 2])]
)
def test_conditions(spark, cond, text, kept):
    df = spark.createDataFrame([(0, None), (1, 3), (2, 8)], "node_id long, age int")
    assert [r[0] for r in df.where(attribute_condition("age", "int", cond, text)).orderBy("node_id").collect()] == kept


def test_induced_and_summary(spark):
    edges = frame(spark, [(0, 1), (1, 2), (2, 0)])
    assert [tuple(r)[:2] for r in graph.induced(edges, nodes(spark, 2)).collect()] == [(0, 1)]
    df = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate([(1, "a"), (2, "b"), (None, None), (10, "b"), (4, "a")])], "node_id long, x int, c string")
    r = graph.summary(df, "x", "int").first()
    assert (r["count"], r["missing"], r["percentage"], r["median"], r["q1"], r["q3"]) == (4, 1, 80.0, 3.0, 1.75, 5.5)
    assert graph.summary(df, "c", "char").orderBy(F.desc("count"), "first_node").first()["value"] == "a"


def test_generators(spark):
    n = nodes(spark, 300)
    ws = {tuple(r)[:2] for r in graph.canonical(generators.watts_strogatz(n, 6, 0.3, 1), False).collect()}
    assert len(ws) == 900 and all(a != b for a, b in ws) and ws != {tuple(r)[:2] for r in generators.watts_strogatz(n, 6, 0.3, 2).collect()}
    ba = [tuple(r)[:2] for r in generators.barabasi_albert(n, 3, 1).collect()]
    assert len(ba) == len(set(ba)) == 6 + 3 * 296
    er = generators.erdos_renyi(n, 0.02, True, False, 1)
    assert abs(er.count() - 0.02 * 300 * 299) < 5 * (0.02 * 300 * 299) ** 0.5 and er.where("src = dst").isEmpty()
    assert sorted(map(tuple, er.collect())) == sorted(map(tuple, generators.erdos_renyi(n.repartition(7), 0.02, True, False, 1).collect()))
    assert generators.erdos_renyi(nodes(spark, 9), 1.0, False, True, 1).count() == 45
    two = generators.random_two_mode(n, 20, 5, 1)
    assert abs(two.count() / 300 - 5) < 0.6 and two.distinct().count() == two.count()
    u = [r[0] for r in n.select(generators.random_attribute("int", 1, "s", 3, 5)).collect()]
    assert set(u) == {3, 4, 5}


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = [tuple(r) for r in graph.numbered(df, "x", "k").orderBy("k").collect()]
    assert [x for x, _ in got] == sorted(x for x, _ in got) and [k for _, k in got] == list(range(1000))


def test_alters(spark):
    edges = frame(spark, [(0, 1), (1, 0), (0, 2), (3, 0)])
    get = lambda k: sorted(r[0] for r in graph.alters(edges, True, 0, k).collect())
    assert (get("out"), get("in"), get("both")) == ([1, 2], [1, 3], [1, 2, 3])
    assert list(itertools.chain.from_iterable(graph.alters(frame(spark, [(0, 0), (0, 1)]), False, 0).orderBy("alter").collect())) == [0, 1]


def test_long_chain_is_one_component(spark):
    """The rounds end at the fixed point, however far the labels travel."""
    pairs = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.min_labels(pairs).agg(F.max("label"), F.count("*")).first() == (0, 3001)


def test_rewiring_ends_where_no_place_is_left(spark):
    edges = generators.watts_strogatz(nodes(spark, 5), 4, 1.0, 7).collect()
    assert len({(r["src"], r["dst"]) for r in edges}) == 10


def test_two_mode_degree_with_and_without_bitmaps(spark):
    rng = random.Random(6)
    members = sorted({(f"h{h}", rng.randrange(60)) for h in range(25) for _ in range(rng.choice([2, 3, 30]))})
    expected = {n: len({m for h, m in members if m != n and (h, n) in set(members)}) for n in range(60)}
    df = spark.createDataFrame(members, "hyper_name string, node_id long")
    for large in (0, 2, 10, 128):
        assert {r["node_id"]: r["degree"] for r in graph.two_mode_degree(nodes(spark, 60), df, large).collect()} == expected, large


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    session = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="yarn"), conf=conf)
    with pytest.raises(Failure):
        checkpoint_folder(session)
