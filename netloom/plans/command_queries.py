"""Queries that drive the command language and the files over the whole test tables, and the SQL that says the same.

Each query opens a session whose variables are the register of nodes (`nodes`) and a network on it (`net`) with the layers
`trade` (directed, valued), `calls` (undirected, valued) and `groups` (2-mode), runs commands, and gives the answer or the structure
that is left as a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.errors import Failure
from netloom.functions.tables import checkpoint_folder, table
from netloom.operators import graph
from netloom.operators.model import Network, Nodeset
from netloom.plans.network_queries import _ARCS, _MEMBERS, _NODES, _TIES, IN, JOINED, JOINED_TOO, KINDS, OUT, TIED, arcs_of, doubled, members_of, nodes_of, ties_of
from netloom.plans.session import REGISTRY, Session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ALL = f"{_NODES}, {_ARCS}, {_TIES}, {_MEMBERS}"


def opened(spark: SparkSession, d: str) -> Session:
    folder = checkpoint_folder(spark)
    folder = folder[5:] if folder.startswith("file:") else folder
    s = Session(spark, f"{folder.rstrip('/')}/netloom-{uuid.uuid4().hex}")
    nodes = Nodeset(spark, "nodes", nodes_of(spark, d).drop("Deleted"), dict(KINDS))
    net = Network(spark, "net", nodes, s.settings)
    net.add_one_mode("trade", True, True, True, arcs_of(spark, d))
    net.add_one_mode("calls", False, True, True, ties_of(spark, d))
    net.add_two_mode("groups", members_of(spark, d))
    s.variables = {"nodes": nodes, "net": net}
    return s


def told(s: Session, *lines: str):
    """The payload of the last line; all lines must succeed."""
    r = None
    for line in lines:
        r = s.run(line)
        if not r.success:
            raise Failure(r.code, f"{line}: {r.message}")
    return r.payload


def add(name: str, build: Callable[[Session, str], object], sql: str, schema: str = "") -> None:
    """build gives a DataFrame, or rows for the schema (a single value for a single column)."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        found = build(opened(spark, d), d)
        if isinstance(found, DataFrame):
            return found
        rows = found if isinstance(found, list) else [found]
        return spark.createDataFrame([x if isinstance(x, tuple) else (x,) for x in rows], schema)

    QUERIES[f"c_{name}"] = query
    SQL[f"c_{name}"] = sql


def edges(s: Session, layer: str, net: str = "net") -> DataFrame:
    return doubled(s.variables[net].layers[layer].df.select("src", "dst", "value"))


def members(s: Session, layer: str = "groups", net: str = "net") -> DataFrame:
    return s.variables[net].layers[layer].df.select("hyper_name", "node_id")


def ids(s: Session, name: str = "nodes") -> DataFrame:
    return s.variables[name].df.select("node_id")


def layers(s: Session, net: str = "net") -> list[tuple]:
    told_ = told(s, f"info({net})")["Layers"]
    return [(x["Name"], x["Mode"], x.get("Directionality"), x.get("ValueType"), x.get("NbrEdges", x.get("NbrHyperedges"))) for x in told_]


EDGES = "select src, dst, cast(value as double) as value from {}"
NODE = "select node_id from nodes"
LAYER_COLUMNS = "name string, mode int, direction string, kind string, n long"
LAYERS = """select 'trade' as name, 1::integer as mode, 'directed' as direction, 'valued' as kind, (select count(*) from arcs) as n
  union all select 'calls', 1, 'undirected', 'valued', (select count(*) from ties) union all select 'groups', 2, null, null, (select count(distinct hyper_name) from members)"""
FIRST_ARC = "(select src, dst from arcs order by src, dst limit 1)"
FIRST_GROUP = "(select min(hyper_name) from members)"


def first_arc(s: Session) -> tuple[int, int]:
    r = s.variables["net"].layers["trade"].df.orderBy("src", "dst").first()
    return r["src"], r["dst"]


def first_group(s: Session) -> str:
    return members(s).agg(F.min("hyper_name")).first()[0]


# structures and environment
add("createnodeset", lambda s, d: (told(s, "fresh = createnodeset(createnodes=5000)"), ids(s, "fresh"))[1], "select range as node_id from range(5000)")
add(
    "createnetwork",
    lambda s, d: (told(s, "second = createnetwork(nodes, name='Second')"), told(s, "getnbrnodes(second)"))[1],
    f"with {_NODES} select count(*) as n from nodes", "n long",
)
add("i", lambda s, d: sorted(told(s, "i()").items()), "select 'net' as name, 'Network' as kind union all select 'nodes', 'Nodeset'", "name string, kind string")
add("delete", lambda s, d: (told(s, "delete(net)", "delete(nodes)"), len(told(s, "i()")))[1], "select 0::bigint as n", "n long")
add("deleteall", lambda s, d: (told(s, "deleteall()"), len(told(s, "i()")))[1], "select 0::bigint as n", "n long")
add("info_network", lambda s, d: layers(s), f"with {ALL} {LAYERS}", LAYER_COLUMNS)
add(
    "info_nodeset",
    lambda s, d: [(x["Name"], x["Type"]) for x in told(s, "info(nodes)")["NodeAttributes"]],
    "select unnest(['Status', 'Gender', 'Office', 'Practice', 'LawSchool', 'YearsWithFirm', 'Age']) as name, unnest(['Char', 'Char', 'Char', 'Char', 'Char', 'Int', 'Int']) as kind", "name string, kind string",
)
add(
    "preview",
    lambda s, d: [(layer, *map(int, x.split("\t")[:2])) for layer in ("trade", "calls") for x in told(s, "preview(net)")[layer]],
    f"""with {ALL} (select 'trade' as layer, src, dst from arcs order by src, dst limit 10) union all (select 'calls', src, dst from ties order by src, dst limit 10)""",
    "layer string, src long, dst long",
)
add("help", lambda s, d: sorted(told(s, "help()")), "select unnest([" + ", ".join(f"'{k}'" for k in sorted(REGISTRY)) + "]) as name", "name string")
add("setting", lambda s, d: (told(s, "setting(onlyoutboundedges, true)"), len(told(s, f"getnodealters(net, {IN}, layernames=trade, direction=in)")))[1], "select 0::bigint as n", "n long")
add("randomseed", lambda s, d: (told(s, "randomseed(77)"), told(s, "getrandomnode(nodes)") == (told(s, "randomseed(77)"), told(s, "getrandomnode(nodes)"))[1])[1], "select true as again", "again boolean")

# nodes and attributes
add("addnode", lambda s, d: (told(s, "addnode(nodes, 4294967295)"), ids(s))[1], f"with {_NODES} {NODE} union all select 4294967295")
add("removenode", lambda s, d: (told(s, f"removenode(nodes, {OUT})"), ids(s))[1], f"with {_NODES} {NODE} where node_id <> {OUT}")
add("removenode_edges", lambda s, d: (told(s, f"removenode(nodes, {OUT})"), edges(s, "trade"))[1], f"with {_ARCS} {EDGES.format('arcs')} where src <> {OUT} and dst <> {OUT}")
add("removenode_members", lambda s, d: (told(s, f"removenode(nodes, {JOINED})"), members(s))[1], f"with {_MEMBERS} select * from members where node_id <> {JOINED}")
add("getnbrnodes", lambda s, d: told(s, "getnbrnodes(net)"), f"with {_NODES} select count(*) as n from nodes", "n long")
add("getallnodes", lambda s, d: told(s, "getallnodes(nodes, offset=100, limit=250)"), f"with {_NODES} {NODE} order by node_id limit 250 offset 100", "node_id long")
add("getnodeidbyindex", lambda s, d: told(s, "getnodeidbyindex(nodes, 321)"), f"with {_NODES} {NODE} order by node_id limit 1 offset 321", "node_id long")
_WITH = lambda df, a: df.select("node_id", F.col(a).alias("value"))
add("defineattr", lambda s, d: (told(s, "defineattr(nodes, rank, int)"), _WITH(s.variables["nodes"].df, "rank"))[1], f"with {_NODES} select node_id, null::integer as value from nodes")
add("undefineattr", lambda s, d: (told(s, "undefineattr(nodes, Age)"), sorted(x["Name"] for x in told(s, "info(nodes)")["NodeAttributes"]))[1], "select unnest(['Gender', 'LawSchool', 'Office', 'Practice', 'Status', 'YearsWithFirm']) as name", "name string")
add("setattr", lambda s, d: (told(s, f"setattr(nodes, {OUT}, Age, 51)"), _WITH(s.variables["nodes"].df, "Age"))[1], f"with {_NODES} select node_id, case when node_id = {OUT} then 51 else Age end as value from nodes")
add("removeattr", lambda s, d: (told(s, f"removeattr(nodes, {OUT}, Age)"), _WITH(s.variables["nodes"].df, "Age"))[1], f"with {_NODES} select node_id, case when node_id <> {OUT} then Age end as value from nodes")
add("getattr", lambda s, d: str(told(s, f"getattr(nodes, {TIED}, Office)") or ""), f"with {_NODES} select coalesce(Office, '') as value from nodes where node_id = {TIED}", "value string")
add(
    "getattrs",
    lambda s, d: sorted(told(s, f"getattrs(nodes, '{IN};{OUT};{TIED};{JOINED}', Office)").items()),
    f"with {_NODES} select node_id, Office as value from nodes where node_id in ({IN}, {OUT}, {TIED}, {JOINED})", "node_id long, value string",
)
add(
    "generateattr",
    lambda s, d: (
        told(s, "generateattr(nodes, luck, attrtype=int, min=3, max=12)", "generateattr(nodes, coin, attrtype=bool, p=0.25)", "generateattr(nodes, share, attrtype=float)", "generateattr(nodes, sign, attrtype=char, chars='a;b')"),
        s.variables["nodes"].df.agg(
            F.count("luck").alias("n"), F.bool_and(F.col("luck").between(3, 12)).alias("whole"), F.bool_and(F.col("share").between(0, 1)).alias("real"), F.bool_and(F.col("sign").isin("a", "b")).alias("letters"),
            # five standard deviations about what is expected
            (F.abs(F.avg("luck") - 7.5) < 5 * F.sqrt(F.lit(99 / 12.0) / F.count("luck"))).alias("mean"), (F.abs(F.avg(F.col("coin").cast("int")) - 0.25) < 5 * F.sqrt(F.lit(0.1875) / F.count("coin"))).alias("rate"),
        ),
    )[1],
    f"with {_NODES} select count(*) as n, true as whole, true as real, true as letters, true as mean, true as rate from nodes",
)
add(
    "filter_chain",
    lambda s, d: (told(s, "older = filter(nodes, Age, ge, 40)", "some = filter(older, Office, ne, B)"), ids(s, "some"))[1],
    f"with {_NODES} {NODE} where Age >= 40 and (Office is null or Office <> 'B')",
)
add("getattrsummary", lambda s, d: (lambda p: (p["Mean"], p["Median"], float(p["Min"]), float(p["Max"])))(told(s, "getattrsummary(nodes, Age)")), f"with {_NODES} select avg(Age) as mean, quantile_cont(Age, 0.5) as median, min(Age)::double as low, max(Age)::double as high from nodes", "mean double, median double, low double, high double")

# layers, edges and hyperedges
add("addlayer", lambda s, d: (told(s, "addlayer(net, more, 1, directed=true)"), layers(s))[1], f"with {ALL} {LAYERS} union all select 'more', 1, 'directed', 'binary', 0", LAYER_COLUMNS)
add("removelayer", lambda s, d: (told(s, "removelayer(net, calls)"), layers(s))[1], f"with {ALL} select * from ({LAYERS}) where name <> 'calls'", LAYER_COLUMNS)
add("clearlayer", lambda s, d: (told(s, "clearlayer(net, calls)"), layers(s))[1], f"with {ALL} select name, mode, direction, kind, case when name = 'calls' then 0 else n end as n from ({LAYERS})", LAYER_COLUMNS)
add("addedge", lambda s, d: (told(s, "addedge(net, trade, 4294967294, 4294967295, 2.5)"), edges(s, "trade"))[1], f"with {_ARCS} {EDGES.format('arcs')} union all select 4294967294, 4294967295, 2.5")
add("addedge_nodes", lambda s, d: (told(s, "addedge(net, trade, 4294967294, 4294967295, 2.5)"), ids(s))[1], f"with {_NODES} {NODE} union all select 4294967294 union all select 4294967295")


def _removed(s: Session, d: str) -> DataFrame:
    known = edges(s, "trade").join(ids(s).withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids(s).withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    a = known.orderBy("src", "dst").first()
    told(s, f"removeedge(net, trade, {a['src']}, {a['dst']})")
    return edges(s, "trade")


_KNOWN_ARC = "(select src, dst from arcs where src in (select node_id from nodes) and dst in (select node_id from nodes) order by src, dst limit 1)"
add("removeedge", _removed, f"with {_NODES}, {_ARCS} {EDGES.format('arcs')} where (src, dst) not in {_KNOWN_ARC}")
add(
    "checkedge",
    lambda s, d: [(layer, told(s, f"checkedge(net, {layer}, {a}, {b})")) for layer, a, b in (("trade", OUT, IN), ("calls", IN, OUT), ("groups", JOINED, JOINED_TOO))],
    f"""with {ALL} select 'trade' as layer, exists(select 1 from arcs where src = {OUT} and dst = {IN}) as tied union all select 'calls', exists(select 1 from both_ways where src = {OUT} and dst = {IN})
  union all select 'groups', exists(select 1 from members x join members y on x.hyper_name = y.hyper_name where x.node_id = {JOINED} and y.node_id = {JOINED_TOO})""", "layer string, tied boolean",
)
add(
    "getedge",
    lambda s, d: [(layer, told(s, f"getedge(net, {layer}, {a}, {b})")) for layer, a, b in (("trade", OUT, IN), ("calls", IN, OUT), ("groups", JOINED, JOINED_TOO))],
    f"""with {ALL} select 'trade' as layer, coalesce((select value::double from arcs where src = {OUT} and dst = {IN}), 0) as value union all select 'calls', coalesce((select max(value)::double from both_ways where src = {OUT} and dst = {IN}), 0)
  union all select 'groups', (select count(*)::double from members x join members y on x.hyper_name = y.hyper_name where x.node_id = {JOINED} and y.node_id = {JOINED_TOO})""", "layer string, value double",
)
add(
    "getalledges",
    lambda s, d: [(x["node1"], x["node2"], float(x["value"])) for x in told(s, "getalledges(net, calls, offset=50, limit=400)")],
    f"with {_TIES} {EDGES.format('ties')} where src < dst order by src, dst limit 400 offset 50", "src long, dst long, value double",
)
add("addhyper", lambda s, d: (told(s, f"addhyper(net, groups, new, nodes='{IN};{OUT};4294967295')"), members(s))[1], f"with {_MEMBERS} select * from members union all select 'new', unnest([{IN}, {OUT}, 4294967295])")
add("removehyper", lambda s, d: (told(s, f"removehyper(net, groups, '{first_group(s)}')"), members(s))[1], f"with {_MEMBERS} select * from members where hyper_name <> {FIRST_GROUP}")
add("addaff", lambda s, d: (told(s, f"addaff(net, groups, {OUT}, brandnew)"), members(s))[1], f"with {_MEMBERS} select * from members union all select 'brandnew', {OUT}")


def _left(s: Session, d: str) -> DataFrame:
    one = members(s).join(ids(s), "node_id", "left_semi").orderBy("hyper_name", "node_id").select("hyper_name", "node_id").first()
    told(s, f"removeaff(net, groups, {one['node_id']}, '{one['hyper_name']}')")
    return members(s)


add("removeaff", _left, f"with {_NODES}, {_MEMBERS} select * from members where (hyper_name, node_id) not in (select hyper_name, node_id from members where node_id in (select node_id from nodes) order by 1, 2 limit 1)")
add("getallhyperedges", lambda s, d: told(s, "getallhyperedges(net, groups, offset=20, limit=100)"), f"with {_MEMBERS} select distinct hyper_name from members order by 1 limit 100 offset 20", "hyper_name string")
add("gethyperedgenodes", lambda s, d: told(s, f"gethyperedgenodes(net, groups, '{first_group(s)}')"), f"with {_MEMBERS} select node_id from members where hyper_name = {FIRST_GROUP}", "node_id long")
add("getnodehyperedges", lambda s, d: told(s, f"getnodehyperedges(net, groups, {JOINED})"), f"with {_MEMBERS} select hyper_name from members where node_id = {JOINED}", "hyper_name string")
_NEAR = f"""select dst as alter from arcs where src = {OUT} union select src from arcs where dst = {OUT} union select dst from both_ways where src = {OUT}
  union select y.node_id from members x join members y on x.hyper_name = y.hyper_name and y.node_id <> x.node_id where x.node_id = {OUT}"""
add("getnodealters", lambda s, d: told(s, f"getnodealters(net, {OUT})"), f"with {ALL} {_NEAR}", "alter long")
# random answers are members of what they are drawn from
add("getrandomnode", lambda s, d: ids(s).where(F.col("node_id") == told(s, "getrandomnode(nodes)")).agg(F.count("*").alias("n")), "select 1::bigint as n")
add("getrandomalter", lambda s, d: told(s, f"getrandomalter(net, {OUT}, layername=trade)") in told(s, f"getnodealters(net, {OUT}, layernames=trade)"), "select true as ok", "ok boolean")
add(
    "getrandomedge",
    lambda s, d: [(layer, (lambda e: told(s, f"checkedge(net, {layer}, {e['node1']}, {e['node2']})") if layer == "groups" else told(s, f"getedge(net, {layer}, {e['node1']}, {e['node2']})") == e["value"])(told(s, f"getrandomedge(net, {layer})"))) for layer in ("trade",)],
    "select 'trade' as layer, true as ok", "layer string, ok boolean",
)

# analytics and transformations through the commands
_ATTRIBUTE = lambda s, a: s.variables["nodes"].df.select("node_id", F.col(a).alias("value"))
add("degree", lambda s, d: _ATTRIBUTE(s, told(s, "degree(net, trade, direction=both)")), f"with {_NODES}, {_ARCS}, ends as (select src as e from arcs union all select dst from arcs) select n.node_id, cast(count(e) as integer) as value from nodes n left join ends on e = n.node_id group by n.node_id")
add("density", lambda s, d: told(s, "density(net, calls)"), f"with {_NODES}, {_TIES} select (select count(*) from ties) / ((select count(*) from nodes) * ((select count(*) from nodes) + 1) / 2)::double as density", "density double")
add(
    "symmetrize", lambda s, d: edges(s, told(s, "symmetrize(net, trade, method=sum)")),
    f"with {_ARCS} select least(src, dst) as src, greatest(src, dst) as dst, cast(cast(case when least(src, dst) = greatest(src, dst) then sum(value) * 2 else sum(value) end as float) as double) as value from arcs group by 1, 2 having sum(value) > 0",
)
add("dichotomize", lambda s, d: edges(s, told(s, "dichotomize(net, trade, cond=gt, threshold=15)")), f"with {_ARCS} select src, dst, 1.0::double as value from arcs where value > 15")
add("subnet", lambda s, d: (told(s, "some = filter(nodes, Office, eq, B)", "part = subnet(net, some)"), members(s, net="part"))[1], f"with {_NODES}, {_MEMBERS} select * from members where node_id in (select node_id from nodes where Office = 'B')")
add(
    "loadscript",
    lambda s, d: (_script(s, ["# a comment", "old = filter(nodes, Age, ge, 50)", "", "getnbrnodes(old)"]), list(told(s, "loadscript(todo.txt)").values())[0])[1],
    f"with {_NODES} select count(*) as n from nodes where Age >= 50", "n long",
)


def _script(s: Session, lines: list[str]) -> None:
    import os

    os.makedirs(s.folder, exist_ok=True)
    with open(s.path("todo.txt"), "w") as f:
        f.write("\n".join(lines))


# files and imports
def _saved(ends: str) -> Callable[[Session, str], DataFrame]:
    def run(s: Session, d: str) -> DataFrame:
        import os

        os.makedirs(s.folder, exist_ok=True)
        told(s, f"savefile(nodes, nodes.{ends})", f"savefile(net, net.{ends})", f"back = loadfile(net.{ends}, network)")
        out = None
        for layer in ("trade", "calls"):
            part = edges(s, layer, "back").select(F.lit(layer).alias("part"), F.col("src").cast("string").alias("a"), F.col("dst").alias("b"), "value")
            out = part if out is None else out.unionByName(part)
        out = out.unionByName(members(s, "groups", "back").select(F.lit("groups").alias("part"), F.col("hyper_name").alias("a"), F.col("node_id").alias("b"), F.lit(1.0).alias("value")))
        ages = s.variables["back_nodeset"].df.select(F.lit("nodes").alias("part"), F.col("Office").alias("a"), F.col("node_id").alias("b"), F.col("Age").cast("double").alias("value"))
        return out.unionByName(ages)

    return run


_EVERYTHING = f"""with {ALL} select 'trade' as part, src::varchar as a, dst as b, value::double as value from arcs union all select 'calls', src::varchar, dst, value::double from ties
  union all select 'groups', hyper_name, node_id, 1.0 from members union all select 'nodes', Office, node_id, Age::double from nodes"""
for _ends in ("tsv", "tsv.gz", "bin", "bin.gz", "parquet"):
    add(f"files_{_ends.replace('.', '_')}", _saved(_ends), _EVERYTHING)


def _imported(rows: Callable[[Session, str], DataFrame], layer: str, how: str) -> Callable[[Session, str], DataFrame]:
    """Lines written as a folder of text, then imported into a new layer."""

    def run(s: Session, d: str) -> DataFrame:
        rows(s, d).write.text(s.path("lines"))
        told(s, f"addlayer(net, imported, {layer})", f"importlayer(net, imported, lines, {how})")
        return members(s, "imported") if layer.startswith("2") else edges(s, "imported")

    return run


def _line(*cells: str) -> Column:
    return F.concat_ws(";", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells]).alias("line")


_IN_NODES = "src in (select node_id from nodes) and dst in (select node_id from nodes)"
add(
    "import_edgelist",
    _imported(lambda s, d: table(s.spark, d, "trade_edges").select(_line("from", "to")), "1, directed=true", "edgelist, sep=';'"),
    f"""with {_NODES} select distinct src, dst, 1.0::double as value from (select "from" as src, "to" as dst from trade_edges) where {_IN_NODES} and src between 0 and 4294967295 and dst between 0 and 4294967295""",
)
add(
    "import_edgelist_adding_nodes",
    lambda s, d: (_imported(lambda s, d: table(s.spark, d, "trade_edges").select(_line("value", "to", "from")), "1", "edgelist, sep=';', node1col=2, node2col=1, addmissingnodes=true")(s, d), ids(s))[1],
    f"""with {_NODES}, ok as (select "from" as src, "to" as dst from trade_edges where "from" between 0 and 4294967295 and "to" between 0 and 4294967295) {NODE} union select src from ok union select dst from ok""",
)
add(
    "import_valued_edgelist",
    _imported(lambda s, d: doubled(arcs_of(s.spark, d)).select(_line("src", "dst", "value")), "1, directed=true, valuetype=valued", "edgelist, sep=';'"),
    f"with {_NODES}, {_ARCS} {EDGES.format('arcs')} where {_IN_NODES}",
)
add(
    "import_two_mode",
    _imported(lambda s, d: members_of(s.spark, d).select(_line("hyper_name", "node_id")), "2", "edgelist, sep=';', nodecol=1, affcol=0"),
    f"with {_NODES}, {_MEMBERS} select * from members where node_id in (select node_id from nodes)",
)
# trade between nations, whole, as a square matrix
_FLOWS = """flows as (select s_nationkey as src, c_nationkey as dst, count(*)::double as value from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey group by 1, 2), labels as (select n_nationkey as k, 25 - n_nationkey as place from nation)"""


def _matrix(s: Session, d: str) -> DataFrame:
    """Nations as rows and columns, in descending order, so that places and labels run against each other."""
    spark = s.spark
    sold = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flows = sold.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("value"))
    nations = [r[0] for r in table(spark, d, "nation").select("n_nationkey").orderBy(F.desc("n_nationkey")).collect()]  # 25 rows, fixed
    wide = table(spark, d, "nation").select(F.col("n_nationkey").alias("src")).join(flows.groupBy("src").pivot("dst", nations).agg(F.sum("value")), "src", "left")
    lines = wide.select(F.col("src").alias("k"), F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("0")) for c in ["src", *nations]]).alias("line"))
    head = spark.createDataFrame([(2**31, "\t" + "\t".join(map(str, nations)))], "k long, line string")
    return head.unionByName(lines.select(F.col("k").cast("long").alias("k"), "line")).coalesce(1).sortWithinPartitions(F.desc("k")).select("line")


add("import_matrix_directed", _imported(_matrix, "1, directed=true, valuetype=valued, selfties=true", "matrix, addmissingnodes=true"), f"with {_FLOWS} select src::bigint as src, dst::bigint as dst, value from flows")
add(
    "import_matrix_upper", _imported(_matrix, "1, valuetype=valued", "matrix, addmissingnodes=true"),
    # rows and columns descend, so a cell above the diagonal has the larger nation in its row
    f"with {_FLOWS} select least(src, dst)::bigint as src, greatest(src, dst)::bigint as dst, value from flows where src > dst",
)
add(
    "exportlayer",
    lambda s, d: (told(s, "exportlayer(net, calls, 'out/', header=false, sep=';')"), s.spark.read.csv(s.path("out"), sep=";", schema="src long, dst long, value float").transform(doubled))[1],
    f"with {_TIES} {EDGES.format('ties')}",
)
