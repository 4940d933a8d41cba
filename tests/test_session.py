import io
import json

import pytest

from netloom.plans.commandline import parse_json, parse_text
from netloom.plans.session import REGISTRY, Session, loop, render_text

WOMEN = {  # fixed values: attendance of a well-known public data set (Davis, Gardner and Gardner 1941)
    "E1": "1 2 4", "E2": "1 2 3", "E3": "1 2 3 4 5 6", "E4": "1 3 4 5", "E5": "1 2 3 4 5 6 7 9", "E6": "1 2 3 4 6 7 8 14", "E7": "2 3 4 5 7 9 10 13 14 15",
    "E8": "1 2 3 4 6 7 8 9 10 11 12 13 15 16", "E9": "1 3 8 9 10 11 12 13 14 16 17 18", "E10": "11 12 13 14 15", "E11": "14 15 17 18", "E12": "10 11 12 13 14 15", "E13": "12 13 14", "E14": "12 13 14",
}
TOWN = """
people = createnodeset(createnodes = 25, name = "Town register")
town = createnetwork(people, name='Town')
defineattr(people, trade, char)
defineattr(people, attrname = year, attrtype = int)
defineattr(structure = people, attrtype = float, attrname = weight)
addlayer(town, letters, 1, directed=true)
addlayer(town, loans, mode=1, valuetype=valued)
addlayer(town, guilds, mode=2)
setattr(people, 3, trade, b)
setattr(people, 4, trade, "s")
setattr(people, 3, weight, 71.25)
addedge(town, letters, 2, 3)
addedge(town, letters, 3, 5)
addedge(town, letters, 5, 7)
addedge(town, letters, 7, 5)
addedge(town, letters, 7, 3)
addedge(town, letters, 7, 9)
addedge(town, letters, 9, 12)
addedge(town, letters, 12, 7)
addedge(town, loans, 7, 3, value = 4)
addedge(town, loans, 3, 5, 2.5)
addedge(town, loans, 9, 12, value = 30)
addhyper(town, guilds, smiths, "3;5;9")
addhyper(town, guilds, bakers, nodes = '5;9;12;14')
addhyper(town, guilds, retired)
addaff(town, guilds, 3, bakers)
addaff(town, guilds, 14, weavers)
"""


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    s = Session(spark, str(tmp_path_factory.mktemp("work")))
    for line in filter(None, TOWN.splitlines()):
        r = s.run(line)
        assert r.success, (line, r)
    return s


def test_there_are_59_commands():
    assert len(REGISTRY) == 59


@pytest.mark.parametrize(
    "line, payload",
    [
        ("density(town, letters)", 8 / (25 * 24)), ("checkedge(town, letters, 3, 7)", False), ("checkedge(town, letters, 7, 3)", True), ("checkedge(town, guilds, 2, 3)", False),
        ("checkedge(town, guilds, 14, 3)", True), ("getedge(town, loans, 3, 7)", 4.0), ("getedge(town, loans, 5, 9)", 0.0), ("getedge(town, guilds, 9, 5)", 2.0), ("getedge(town, guilds, 14, 14)", 2.0),
        ("getnodealters(town, 3, layernames=loans)", [5, 7]), ("getnodealters(town, 7, direction=out, layernames=letters)", [3, 5, 9]), ("getnodealters(town, 7, direction=in, layernames=letters)", [5, 12]),
        ("getnodealters(town, 3, layernames='loans;loans', unique=false)", [5, 7, 5, 7]), ("getattr(town, 3, weight)", 71.25), ("getattr(people, 20, trade)", ""),
        ("getattrs(people, '3;4;6;99', trade)", {3: "b", 4: "s", 6: None}), ("getnbrnodes(town)", 25), ("getallnodes(town, offset=22)", [22, 23, 24]), ("getnodeidbyindex(people, 11)", 11),
        ("getallhyperedges(town, guilds)", ["bakers", "retired", "smiths", "weavers"]), ("gethyperedgenodes(town, guilds, smiths)", [3, 5, 9]), ("gethyperedgenodes(town, guilds, bakers, offset=1, limit=2)", [5, 9]),
        ("getnodehyperedges(town, guilds, 9)", ["bakers", "smiths"]), ("getnodehyperedges(town, guilds, 9, limit=1)", ["bakers"]), ("getnodealters(town, 7, layernames=letters, offset=1, limit=1)", [5]),
        ("shortestpath(town, 2, 14)", 2), ("shortestpath(town, 2, 12, letters)", 5), ("shortestpath(town, 12, 2, letters)", -1), ("shortestpath(town, 6, 6)", 0),
        ("getalledges(town, loans, limit=1)", [{"node1": 3, "node2": 5, "value": 2.5}]), ("getalledges(town, letters, offset=7)", [{"node1": 12, "node2": 7, "value": 1.0}]), ("addedge(town, letters, 20, 21, value=0)", None),
        ("preview(town)", {"letters": ["2\t3\t1.0", "3\t5\t1.0", "5\t7\t1.0", "7\t3\t1.0", "7\t5\t1.0", "7\t9\t1.0", "9\t12\t1.0", "12\t7\t1.0"], "loans": ["3\t5\t2.5", "3\t7\t4.0", "9\t12\t30.0"],
                           "guilds": ["bakers\t3", "bakers\t5", "bakers\t9", "bakers\t12", "bakers\t14", "smiths\t3", "smiths\t5", "smiths\t9", "weavers\t14"]}),
    ],
)
def test_answers(session, line, payload):
    r = session.run(line)
    assert r.success and r.payload == payload, r


@pytest.mark.parametrize(
    "line, code",
    [
        ("wander()", "CommandNotFound"), ("createnodeset()", "InvalidSyntax"), ("here = getwd()", "InvalidSyntax"), ("density(village, letters)", "VariableNotFound"), ("density(town, roads)", "LayerNotFound"),
        ("addnode(people, 8)", "NodeAlreadyExists"), ("addedge(town, letters, 3, 5)", "EdgeAlreadyExists"), ("addedge(town, letters, 6, 6)", "ConstraintSelftiesNotAllowed"), ("addedge(town, letters, 70, 1, addmissingnodes=false)", "NodeNotFound"),
        ("addnode(people, 4294967296)", "UnhandledException"), ("removeedge(town, letters, 3, 7)", "EdgeNotFound"), ("removeaff(town, guilds, 1, smiths)", "ConstraintNodeNotAffiliated"), ("setattr(people, 1, year, soon)", "ParseAttributeValueError"),
        ("getattr(people, 1, colour)", "AttributeUnknown"), ("f = filter(people, trade, eq)", "MissingAttributeValue"), ("f = filter(people, trade, GT, b)", "InvalidCondition"), ("delete(people)", "ConstraintNodesetInUse"),
        ("dichotomize(town, letters)", "ConstraintLayerAlreadyBinary"), ("addlayer(town, loans, 1)", "LayerAlreadyExists"), ("addlayer(town, 9th, 1)", "InvalidLayerName"), ("addlayer(town, roads, 4)", "InvalidMode"),
        ("defineattr(people, trade, int)", "AttributeAlreadyExists"), ("getnodeidbyindex(people, 250)", "InvalidNodeIndex"), ("getrandomalter(town, 22)", "ConstraintNoAlters"), ("setting(colour, true)", "SettingNotFound"),
        ("x = loadfile(lost.tsv, nodeset)", "FileNotFound"), ("x = loadfile(lost.odt, nodeset)", "UnsupportedFileFormat"), ("savefile(town, town.tsv)", "ConstraintUnsavedNodeset"), ("y = createnodeset(createnodes=-3)", "InvalidArgument"),
        (f"addhyper(town, guilds, {'g' * 256})", "NameTooLong"), ("gethyperedgenodes(town, guilds, tailors)", "HyperedgeNotFound"), ("setwd(/no/such/folder)", "DirectoryNotFound"), ("getnbrnodes()", "UnhandledException"),
    ],
)
def test_failures(session, line, code):
    assert session.run(line).code == code


def test_changes_chain_and_cascade(spark, tmp_path):
    s = Session(spark, str(tmp_path))
    for line in filter(None, TOWN.splitlines()):
        s.run(line)
    for line in (
        "degree(town, letters, direction=in)", "reached = filter(people, letters_indegree, ge, 1)", "core = subnet(town, reached)", "components(town, guilds)", "symmetrize(town, letters, method=min)",
        "dichotomize(town, loans, threshold=4)", "generateattr(people, luck, attrtype=bool, p=0.5)", "removeattr(people, 3, trade)", "undefineattr(people, weight)", "addlayer(town, chance, 1)",
        "generate(town, chance, er, p=0.3)", "getrandomedge(town, chance)", "getrandomedge(town, guilds)", "getrandomnode(town)", "removelayer(town, chance)",
    ):
        assert s.run(line).success, line
    edges = lambda where: [(e["node1"], e["node2"]) for e in s.run(f"getalledges({where})").payload]
    assert s.run("getallnodes(reached)").payload == [3, 5, 7, 9, 12]
    assert edges("core, letters") == [(3, 5), (5, 7), (7, 3), (7, 5), (7, 9), (9, 12), (12, 7)]
    assert edges("town, letters-symmetrized") == [(5, 7)] and edges("town, loans-dichotomized") == [(3, 7), (9, 12)]
    assert s.run("getattrsummary(people, letters_indegree)").payload["Mean"] == 8 / 25
    assert s.run("components(town, guilds)").payload == {"NbrComponents": 21, "ComponentSizes": [5] + [1] * 20}
    assert s.run("components(town, guilds, limit=2)").payload == {"NbrComponents": 21, "ComponentSizes": [5, 1]}
    assert s.run("removenode(people, 9)").success and s.run("getnbrnodes(town)").payload == 24
    assert edges("town, letters") == [(2, 3), (3, 5), (5, 7), (7, 3), (7, 5), (12, 7)] and edges("town, loans") == [(3, 5), (3, 7)]
    assert s.run("gethyperedgenodes(town, guilds, smiths)").payload == [3, 5]
    assert s.run("removehyper(town, guilds, smiths)").success and s.run("clearlayer(town, guilds)").success and s.run("getallhyperedges(town, guilds)").payload == []
    assert s.run("getrandomedge(town, guilds, maxattempts=0)").code == "EdgeNotFound"
    s.run("setting(onlyoutboundedges, true)")
    assert s.run("getnodealters(town, 7, layernames=letters, direction=in)").payload == []
    assert s.run("deleteall()").success and s.run("i()").payload == {}


@pytest.mark.parametrize("ends", [("tsv", "tsv"), ("tsv.gz", "tsv.gz"), ("bin", "bin"), ("bin.gz", "bin.gz"), ("parquet", "parquet"), ("bin", "tsv")])
def test_round_trips(session, ends):
    assert session.run(f'savefile(people, "people.{ends[0]}")').success
    r = session.run(f'savefile(town, "town.{ends[1]}")')
    assert r.success, r
    assert session.run(f'back = loadfile("town.{ends[1]}", network)').assigned == {"back": "Network", "back_nodeset": "Nodeset"}
    for line in ("getalledges({}, letters)", "getalledges({}, loans)", "getallhyperedges({}, guilds)", "gethyperedgenodes({}, guilds, smiths)", "getattrs({}, '3;4;5', trade)", "getattr({}, 3, weight)", "getnbrnodes({})"):
        assert session.run(line.format("back")).payload == session.run(line.format("town")).payload, line
    assert session.run("info(back)").payload["Layers"] == session.run("info(town)").payload["Layers"]


@pytest.mark.parametrize("ends", ["tsv.gz", "bin", "parquet"])
def test_addresses_with_a_scheme(session, ends):
    """As an object store's; here that of the local files."""
    there = f"file://{session.folder}/store"
    assert session.run(f'savefile(people, "{there}/people.{ends}")').success
    r = session.run(f'savefile(town, "{there}/town.{ends}")')
    assert r.success, r
    assert session.run(f'away = loadfile("{there}/town.{ends}", network)').success
    assert session.run("getalledges(away, loans)").payload == session.run("getalledges(town, loans)").payload
    assert session.run(f'x = loadfile("{there}/gone.{ends}", nodeset)').code == "FileNotFound"
    assert session.run(f'exportlayer(town, loans, "{there}/loans.csv")').success
    session.run("removelayer(town, afar)")
    session.run("addlayer(town, afar, 1, valuetype=valued)")
    assert session.run(f'importlayer(town, afar, "{there}/loans.csv", edgelist, header=true)').success
    assert session.run("getalledges(town, afar)").payload == session.run("getalledges(town, loans)").payload
    session.run("removelayer(town, afar)")


def test_hand_written_file(spark, tmp_path):
    (tmp_path / "n.tsv").write_text("set\tgender:Char\tweight:Float\n1\tm\t1.5\n2\t\t\n\n3\tx\n1\tf\t\n")
    (tmp_path / "net.tsv").write_text("# c\nName: x\nNodesetFile: n.tsv\n\nLayerMode: 1\nLayerName: t\nDirectionality: directed\nValueType: valued\nSelfties: false\n1\t2;5\t3;0.25\t\n2\t1;0\n\nLayerMode: 2\nLayerName: w\na:b\t1\t2\t2\nempty\n")
    s = Session(spark, str(tmp_path))
    assert s.run("x = loadfile(net.tsv, network)").success
    assert [tuple(e.values()) for e in s.run("getalledges(x,t)").payload] == [(1, 2, 5.0), (1, 3, 0.25)]
    assert s.run("getallhyperedges(x,w)").payload == ["a:b", "empty"] and s.run("getattrs(x,'1;2;3',gender)").payload == {1: "f", 2: None, 3: "x"} and s.run("getattr(x,1,weight)").payload == 1.5
    (tmp_path / "wide.tsv").write_text("set\tg:Char\n1\tm\tq\n")
    s.run("y = loadfile(wide.tsv, nodeset)")
    with pytest.raises(Exception, match="more cells"):
        s.run("getnbrnodes(y)")


def write(session, name, text):
    with open(session.path(name), "w") as f:
        f.write(text)


def found(session, layer):
    return [tuple(e.values()) for e in session.run(f"getalledges(town, {layer})").payload]


def test_edge_lists(session):
    assert session.run('exportlayer(town, loans, "loans.csv", sep=";")').success
    assert open(session.path("loans.csv")).read().splitlines() == ["node1;node2;value", "3;5;2.5", "3;7;4", "9;12;30"]
    session.run("addlayer(town, again, 1, valuetype=valued)")
    assert session.run('importlayer(town, again, "loans.csv", edgelist, header=true, sep=";")').success
    assert found(session, "again") == found(session, "loans")
    write(session, "more.tsv", "5\t3\t99\n8\t8\t1\n4\t6\t2\n6\t4\t7\nx\t1\t1\n")  # an edge that exists keeps its value, and so does the first of several rows
    assert session.run("importlayer(town, again, more.tsv, edgelist)").success
    assert found(session, "again") == [(3, 5, 2.5), (3, 7, 4.0), (4, 6, 2.0), (9, 12, 30.0)]
    assert session.run("getedge(town, again, 8, 8)").payload == 1.0  # not listed, but there
    write(session, "aff.tsv", "x\tg1\n1\tg1\n2\tg1\n'3'\t\"g2\"\n700\tg2\nshort\n")
    session.run("addlayer(town, aff, 2)")
    assert session.run("importlayer(town, aff, aff.tsv, edgelist)").success and session.run("gethyperedgenodes(town, aff, g2)").payload == [3]
    assert session.run("importlayer(town, aff, aff.tsv, edgelist, addmissingnodes=true)").success and session.run("gethyperedgenodes(town, aff, g2)").payload == [3, 700]
    session.run("removenode(people, 700)")
    assert session.run("importlayer(town, aff, aff.tsv, list)").code == "UnsupportedImportFormat"


@pytest.mark.parametrize(
    "layer, matrix, edges",
    [
        ("directed=true, valuetype=valued", "\t1\t2\t3\n1\t0\t2\tx\n2\t2\t0\t\n3\t0\t4\t1\n", [(1, 2, 2.0), (2, 1, 2.0), (3, 2, 4.0)]),
        # what is above the diagonal counts, by place and not by id
        ("valuetype=valued", "\t3\t2\t1\n3\t0\t5\t6\n2\t9\t0\t7\n1\t9\t9\t0\n", [(1, 2, 7.0), (1, 3, 6.0), (2, 3, 5.0)]),
        ("directed=true, selfties=true", "\t7\t4\n7\t1\t1\n4\t0\t1\n", [(4, 4, 1.0), (7, 4, 1.0), (7, 7, 1.0)]),
        # rows in another order than columns
        ("directed=true", "\t1\t2\n2\t1\t0\n1\t0\t1\n", [(1, 2, 1.0), (2, 1, 1.0)]),
        # empty lines do not count, and a short row ends in cells without a number
        ("valuetype=valued", "\n\t1\t2\t3\n\n1\t0\t2\n2\t0\t0\t4\n\n3\t1\n", [(1, 2, 2.0), (2, 3, 4.0)]),
    ],
)
def test_matrices(session, layer, matrix, edges):
    write(session, "m.tsv", matrix)
    session.run("removelayer(town, mat)")
    assert session.run(f"addlayer(town, mat, 1, {layer})").success
    assert session.run("importlayer(town, mat, m.tsv, matrix)").success
    assert found(session, "mat") == edges


@pytest.mark.parametrize("matrix", ["\t1\t2\t3\n1\t0\t1\t1\n", "\t1\tx\n1\t0\t1\n2\t0\t1\n", "\t1\t2\nx\t0\t1\n2\t0\t1\n"])
def test_matrices_that_are_none(session, matrix):
    """Not as many rows as columns, and a heading or row label that is no id: nothing is imported."""
    write(session, "bad.tsv", matrix)
    session.run("removelayer(town, mat)")
    session.run("addlayer(town, mat, 1, directed=true)")
    assert session.run("importlayer(town, mat, bad.tsv, matrix)").code == "IOImportError"
    assert found(session, "mat") == []


def test_existing_edges_win_in_matrices_and_multi_edges_may_be_kept(session):
    session.run("removelayer(town, mat)")
    session.run("addlayer(town, mat, 1, directed=true, valuetype=valued)")
    session.run("addedge(town, mat, 1, 2, 3)")
    write(session, "m.tsv", "\t1\t2\n1\t0\t9\n2\t4\t0\n")
    assert session.run("importlayer(town, mat, m.tsv, matrix)").success and found(session, "mat") == [(1, 2, 3.0), (2, 1, 4.0)]
    session.run("setting(blockmultiedges, false)")
    assert session.run("importlayer(town, mat, m.tsv, matrix)").success
    session.run("setting(blockmultiedges, true)")
    assert sorted(found(session, "mat")) == [(1, 2, 3.0), (1, 2, 9.0), (2, 1, 4.0), (2, 1, 4.0)]


def test_women(spark, tmp_path):
    s = Session(spark, str(tmp_path))
    s.run("n = createnodeset()"), s.run("w = createnetwork(n)"), s.run("addlayer(w,events,2)")
    for name, who in WOMEN.items():
        s.run(f'addhyper(w,events,{name},nodes="{who.replace(" ", ";")}")')
    assert s.run("getedge(w,events,1,3)").payload == 7.0 and s.run("getedge(w,events,1,18)").payload == 1.0
    assert s.run("density(w,events)").payload == pytest.approx(0.9084967320261438)
    s.run("degree(w,events,attrname=d)")
    values = s.run("getattrs(w,'1;3;9;10;13;14;15;5;17;18',d)").payload
    assert values == {**dict.fromkeys((1, 3, 9, 10, 13, 14, 15), 17), 5: 11, 17: 12, 18: 12}
    assert s.run("components(w,events)").payload == {"NbrComponents": 1, "ComponentSizes": [18]}
    assert s.run("shortestpath(w,5,17)").payload == 2


def test_scripts_help_and_loop(session, spark, tmp_path):
    with open(session.path("s.txt"), "w") as f:
        f.write("# c\nz = createnodeset(createnodes=3)\ngetnbrnodes(z)\nloadscript(s.txt)\n")
    r = session.run("loadscript(s.txt)")
    assert r.success and r.payload == {"[3] getnbrnodes": 3} and r.assigned == {"z": "Nodeset"}
    with open(session.path("bad.txt"), "w") as f:
        f.write("getnbrnodes(z)\ngetnbrnodes(gone)\n")
    r = session.run("loadscript(bad.txt)")
    assert not r.success and "line 2" in r.message
    assert len(session.run("help()").payload) == 59 and "Syntax" in session.run("help(degree)").payload
    assert session.run("help(file=h.txt)").success and session.run("dir()").payload["TotalFiles"] >= 3
    assert session.run("randomseed(5)").payload == 5 and session.run("getwd()").payload == session.folder
    out = io.StringIO()
    loop(spark, ['{"command":"createnodeset","assign":"a","args":{"createnodes":"2"}}', '{"command":"getnbrnodes","args":{"structure":"a"}}', "{bad", '{"command":"i","args":{"x":1}}', "exit"], as_json=True, out=out)
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["Success"] for x in lines] == [True, True, False, False] and lines[1]["Payload"] == 2
    assert render_text(session.run("checkedge(town, letters, 3, 5)")) == "true"


def test_parsers():
    c = parse_text("x = filter(nodes, age, cond = ge, 'a b', last=\"c,d\")")
    assert (c.name, c.assign, c.args) == ("filter", "x", {"arg0": "nodes", "arg1": "age", "cond": "ge", "arg3": "a b", "last": "c,d"})
    assert parse_text("i").name == "i" and parse_text("?") is None and parse_json("[]") is None
    assert parse_text(" I ( ) ").name == "i" and parse_text("a = b = c()") is None and parse_text("f(x") is None and parse_text("f('x)") is None and parse_text("f() g") is None
    assert parse_text("f(a b,,c ,d=1;2)").args == {"arg0": "a", "arg1": "b", "arg2": "c", "d": "1;2"} and parse_text("f('')").args == {"arg0": ""}
