"""One test for each finding of the second round."""

import tracemalloc

import numpy as np
import pytest

from netloom.llm import toxicity
from netloom.operators import generators, graph
from netloom.operators.model import Network, Nodeset
from netloom.plans import network_queries
from netloom.plans.session import Session
from netloom.sources import files


@pytest.fixture
def strange(spark, tmp_path):
    """Nodes 1 to 3, a layer and hyperedges that mostly tie others."""
    s = Session(spark, str(tmp_path))
    nodes = Nodeset(spark, "few", spark.createDataFrame([(1,), (2,), (3,)], "node_id long"))
    net = Network(spark, "odd", nodes, s.settings)
    net.add_one_mode("arcs", True, True, True, spark.createDataFrame([(1, 2, 2.5)] + [(k % 3 + 1, k, 1.0) for k in range(10, 60)], "src long, dst long, value float"))
    net.add_two_mode("groups", spark.createDataFrame([("a", 1), ("a", 3)] + [("b", k) for k in range(2, 60)], "hyper_name string, node_id long"))
    s.variables = {"few": nodes, "odd": net}
    return s


def test_a_random_edge_lies_between_nodes(strange):  # F5
    for seed in range(5):
        strange.run(f"randomseed({seed})")
        e = strange.run("getrandomedge(odd, arcs)").payload
        assert e == {"node1": 1, "node2": 2, "value": 2.5}
        assert strange.run(f"getedge(odd, arcs, {e['node1']}, {e['node2']})").payload == 2.5
        e = strange.run("getrandomedge(odd, groups)").payload
        assert (e["node1"], e["node2"]) in {(1, 3), (2, 3)}


@pytest.mark.parametrize("form", ["bin", "bin.gz"])
def test_a_binary_file_is_read_as_a_stream(spark, tmp_path, monkeypatch, form):  # F2, F4
    s = Session(spark, str(tmp_path))
    n = 60_000
    monkeypatch.setattr(files, "HELD", 5_000, raising=False)
    nodes = Nodeset(spark, "many", spark.range(n).selectExpr("id as node_id", "if(id % 6000 = 0, int(id), null) as `odd name, so`"), {"odd name, so": "int"}, str(tmp_path / f"nodes.{form}"))
    net = Network(spark, "wide", nodes, s.settings)
    net.add_one_mode("hub", True, True, True, spark.range(1, n).selectExpr("if(id % 1000 = 0, id, 0) as src", "id as dst", "float(id % 7) + 0.5f as value"))
    net.add_one_mode("ties", False, False, False, spark.range(1, 1000).selectExpr("id - 1 as src", "id as dst", "1.0f as value"))
    net.add_two_mode("groups", spark.range(n).selectExpr("if(id % 5 = 0, 'é', 'all') as hyper_name", "id as node_id"), spark.createDataFrame([("é",), ("all",), ("none",)], "hyper_name string"))
    files.write_nodeset(nodes, nodes.path)
    files.write_network(net, str(tmp_path / f"net.{form}"))
    tracemalloc.start()
    back, again = files.read_network(spark, str(tmp_path / f"net.{form}"), s.settings)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6, peak  # 12 MB if all rows are objects
    for a, b in [(again.df, nodes.df), *[(back.layers[k].df, net.layers[k].df) for k in net.layers], (back.layers["groups"].names.df, net.layers["groups"].names.df)]:
        assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    with open(tmp_path / "short.bin", "wb") as f, files.opened(nodes.path, "rb") as whole:
        f.write(whole.read()[:-3])
    with pytest.raises(files.Failure, match="too early"):
        files.read_nodeset(spark, str(tmp_path / "short.bin"))


def test_all_segments_are_candidates_and_bear_on_the_threshold(spark, monkeypatch):  # F1, F8
    told = {}

    def train(*given):
        ask, spread = given[-2:]
        told["candidates"] = len(ask(toxicity.Classifier({"rot": 6.0}, -3.0, {}), frozenset(["!"])))
        told["shares"] = spread(["rot", "calm ^"], np.array([[6.0, 1.0], [1.0, 1.0]]), np.array([-3.0, 0.0]), {}, np.array([-4.0, 0.5, 2.9]))
        return "model"

    monkeypatch.setattr(toxicity, "train", train)
    name = lambda k: "".join(chr(97 + 13 * (j % 2) + k // 13**j % 13) for j in range(5))
    texts = [(f"May you rot {name(k)} !" if k < 21_000 else f"The sea is calm {name(k)} .",) for k in range(70_000)]
    docs = spark.createDataFrame(texts, "text string")
    assert toxicity.train_on(docs, spark.createDataFrame([("rot", "insult")], "sample_text string, label string")) == "model"
    assert told["candidates"] == 21_000  # 20,000 were taken before
    assert np.allclose(told["shares"], [[1, 0.3, 0.3], [1, 0.3, 0]])  # of all 70,000 segments, not of 60,000


def test_pairs_that_met_take_little_room(spark, tmp_path):  # F3, F6
    rng = np.random.default_rng(5)
    groups = [(f"g{k}", int(n)) for k in range(40) for n in rng.choice(5000, 100, replace=False)] + [(f"all{m}", n) for m in (2, 3) for n in range(0, 5000, m)]
    members, nodes = spark.createDataFrame(groups, "hyper_name string, node_id long"), spark.range(5000).withColumnRenamed("id", "node_id")
    near = [set() for _ in range(5000)]
    for name in {g for g, _ in groups}:
        own = {n for g, n in groups if g == name}
        for n in own:
            near[n] |= own
    before, there = spark.sparkContext.getCheckpointDir(), str(tmp_path / "shared")
    spark.sparkContext.setCheckpointDir(there)
    try:
        found = dict(graph.two_mode_degree(nodes, members).collect())
    finally:
        spark.sparkContext._jsc.sc().setCheckpointDir(before) if before else None
    assert found == {n: max(0, len(x) - 1) for n, x in enumerate(near)}
    taken = sum(f.stat().st_size for f in (tmp_path / "shared").rglob("*") if f.is_file())
    assert taken < 1e6, taken  # 0.5 MB; 2.7 MB when pairs were checkpointed with their classes


def test_random_edges_are_neither_moved_to_be_named_nor_to_be_compared(spark, tmp_path, monkeypatch):  # F7
    nodes = spark.range(3000).selectExpr("id * 700001 - 5 as node_id")
    moved = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Join")
    drawn = generators.erdos_renyi(nodes, 0.02, True, False, 7)
    assert not moved(drawn)  # two joins of all edges before
    ids = [r[0] for r in nodes.collect()]
    edges = {(r["src"], r["dst"]) for r in drawn.collect()}
    assert edges <= {(a, b) for a in ids for b in ids if a != b} and abs(len(edges) - 3000 * 2999 * 0.02) < 5 * (3000 * 2999 * 0.02) ** 0.5
    row = network_queries._shape_in_short(drawn, nodes).first()
    out = np.array([d for _, d in graph.degree(nodes, drawn, True, "out").collect()])
    assert (row["edges"], row["repeated"], row["selfties"], row["strangers"], row["nodes"]) == (len(edges), 0, 0, 0, 3000) and np.isclose(row["spread"], out.var())
    # tiles of any width hold every pair once
    monkeypatch.setattr(generators, "TILE", 300)
    for n, p in ((310, 1.0), (1100, 0.1)):
        wide = spark.range(n).selectExpr("id * 3 as node_id")
        for directed in (True, False):
            some, most = sorted(map(tuple, generators.erdos_renyi(wide, p, directed, False, 7).collect())), n * (n - 1) // (2 - directed)
            assert len(set(some)) == len(some) and abs(len(some) - most * p) <= 5 * (most * p * (1 - p)) ** 0.5
    assert generators.erdos_renyi(wide, 0.0, True, False, 7).count() == 0


def test_edges_in_short_show_every_flaw(spark):  # F7
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-40, 40, (4000, 2))] + [(3, 10**15), (10**15, 4), (3, 10**15)] + [(5, int(x)) for x in rng.integers(-(10**12), 10**12, 3000)]
    nodes = spark.createDataFrame([(k,) for k in range(-40, 38)], "node_id long")
    for edges in (spark.createDataFrame(pairs, "src long, dst long").repartition(5), spark.createDataFrame(sorted(pairs), "src long, dst long").coalesce(1), spark.createDataFrame([], "src long, dst long")):
        row = network_queries._shape_in_short(edges, nodes).first()
        assert {k: row[k] for k in ("edges", "repeated", "selfties", "strangers", "nodes")} == network_queries._shape(edges, nodes).first().asDict()


def test_many_segments_are_scored_at_once(spark):  # p9_found
    """The same scores as one by one, without looking at segments one by one."""
    rng = np.random.default_rng(2)
    word = lambda: "you are so rotten b*d liar sea calm".split()[rng.integers(8)]
    segs = [([word() for _ in range(rng.integers(1, 13))], str(rng.choice(["", ".", "!!!SO", "S"]))) for _ in range(3000)]
    segs = [(w, m + "M" * ("b*d" in w)) for w, m in segs]
    grams = sorted({g for w, m in segs for g in toxicity._grams([{"b*d": "bad"}.get(x, x) for x in w], m)})
    weights = {g: float(rng.normal()) for g in grams if rng.random() < 0.6}
    model = toxicity.Classifier(weights, -1.5, {("b", "d", 1): "bad"})
    rows = spark.createDataFrame([(" ".join(w), m) for w, m in segs], "words string, marks string").coalesce(1)
    model.score, toxicity_grams = None, toxicity._grams  # not asked for each segment
    scored = rows.mapInArrow(toxicity._score_segments(model), "words string, marks string, score double").toPandas()
    del model.score
    assert np.allclose(scored["score"], [model.score(w, m) for w, m in segs])
    at, names = np.arange(-60, 81) / 10.0, list(weights)
    columns = np.stack([list(weights.values()), np.ones(len(names))], axis=1)
    told = rows.mapInArrow(toxicity._count_scores(names, columns, np.array([-1.5, 0.0]), model.masks, at), "fit int, place int, n long").toPandas()
    number = {g: k for k, g in enumerate(names)}
    sums = [columns[sorted({number[g] for g in toxicity_grams(model.unmask(w), m) if g in number})].sum(axis=0) + [-1.5, 0] for w, m in segs]
    for k in (0, 1):
        got = np.bincount(told["place"][told["fit"] == k], told["n"][told["fit"] == k], len(at) + 1)
        assert (got == np.bincount(np.searchsorted(at, np.round([x[k] for x in sums], 9), "right"), minlength=len(at) + 1)).all()
    texts = ["You are so ROTTEN!!! Sea, calm", "", None, "b*d liar you\nso b*d", "<b></b>", "sooooo r0tten you liar"] * 300
    docs = spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "doc_id long, source string, text string").coalesce(1)
    model.document, scoring = None, toxicity.score_documents(docs, model)
    got = {r["doc_id"]: r["score"] for r in scoring.collect()}
    del model.document
    assert all(np.isclose(got[k], model.document(t) if t else 0.0, rtol=1e-12) for k, t in enumerate(texts)) and len(got) == len(texts)


def test_signs_of_disguise_are_those_of_the_expressions():  # p9_found
    for text in ("aaa", "zzz top", "ab aab", "ñññ", "the ÉÉÉ", "sooo", "111", "___", "aa a", "ΩΩΩ", "ǅǅǅ", "bookkeeper", "ßßß"):
        assert toxicity._stretched(text.lower()) == (toxicity._STRETCH.search(text.lower()) is not None), text
    for text, yes in (("aB", True), ("AB", False), ("a B", False), ("éB", False), ("\nB", False), ("xY\nz", True), ("B", False)):
        assert (toxicity._HUMP.search(text) is not None) == yes, text
