"""The command language: variables, settings, 59 commands, their text and JSON forms, scripts and results."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.chance import DEFAULT_SEED, uniform
from netloom.functions.conditions import SQL_TYPES, attribute_condition
from netloom.functions.errors import Failure
from netloom.operators import generators, graph
from netloom.operators.model import Network, Nodeset, Settings, check_id, check_name, short
from netloom.plans.commandline import Arg, Command, flag, needs, parse_json, parse_text, takes
from netloom.sources import edgelists, files


class ArgumentError(Exception):
    """A required argument is missing or can't be read."""


@dataclass
class Result:
    success: bool
    code: str
    message: str
    payload: object = None
    assigned: dict[str, str] = field(default_factory=dict)

    def as_dict(self, verbose: bool = True) -> dict:
        out = {"Success": self.success, "Code": self.code}
        if verbose:
            out["Message"] = self.message
        return out | {"Payload": self.payload, "Assigned": self.assigned or None}


@dataclass
class Spec:
    name: str
    args: tuple[Arg, ...]
    about: str
    makes: str | None
    run: Callable

    @property
    def syntax(self) -> str:
        """How the command is written, from its arguments."""
        call = f"{self.name}(" + ", ".join(a.name if a.given else f"{a.name}?" for a in self.args) + ")"
        return f"{call} -> {self.makes}" if self.makes else call


REGISTRY: dict[str, Spec] = {}
ALL = 2**31 - 1
PAGE = (takes("offset", "whole number", 0), takes("limit", "whole number", 1000))
#: For lists that are usually short; the lists of a hub are better read by pages.
WHOLE = (takes("offset", "whole number", 0), takes("limit", "whole number", ALL))
STRUCTURE, NETWORK, NODESET, LAYER = needs("structure", "variable"), needs("network", "variable"), needs("nodeset", "variable"), needs("layername")


def command(name: str, *args: Arg, about: str, makes: str | None = None):
    def add(run: Callable) -> Callable:
        REGISTRY[name] = Spec(name, args, about, makes, run)
        return run

    return add


class Args:
    """Access to arguments by name, else by the place at which the command declares them; optional ones that can't be read count as left out."""

    def __init__(self, session: Session, args: dict[str, str], declared: tuple[Arg, ...] = ()):
        self.session, self.args = session, args
        self.places = {a.name: f"arg{k}" for k, a in enumerate(declared)}

    def raw(self, name: str) -> str | None:
        return self.args.get(name, self.args.get(self.places.get(name, "")))

    def text(self, name: str) -> str:
        found = self.raw(name)
        if found is None:
            raise ArgumentError(f"Argument '{name}' is missing.")
        return found

    def node(self, name: str) -> int:
        try:
            return check_id(self.text(name))
        except Failure as e:
            raise ArgumentError(e.message) from e

    def whole(self, name: str) -> int:
        try:
            return int(self.text(name))
        except ValueError as e:
            raise ArgumentError(f"Argument '{name}' is not a whole number.") from e

    def maybe(self, name: str, default):
        """An optional argument of the default's type."""
        raw = self.raw(name)
        if raw is None:
            return default
        try:
            if isinstance(default, bool):
                return {"true": True, "false": False}.get(raw.strip().lower(), default)
            return type(default)(raw) if default is not None else raw
        except ValueError:
            return default

    def choice(self, name: str, default: str, options: tuple[str, ...]) -> str:
        raw = (self.raw(name) or default).strip().lower()
        return raw if raw in options else default

    def structure(self, name: str = "structure"):
        return self.session.variable(self.text(name))

    def nodeset(self, name: str = "structure") -> Nodeset:
        found = self.structure(name)
        return found.nodeset if isinstance(found, Network) else found

    def network(self, name: str = "network") -> Network:
        found = self.structure(name)
        if not isinstance(found, Network):
            raise ArgumentError("The variable is no network.")
        return found

    def page(self, limit: int = 1000) -> tuple[int, int]:
        return max(0, self.maybe("offset", 0)), max(0, self.maybe("limit", limit))


    def listed(self, rows: DataFrame, *by) -> list:
        """The first column in order, by pages if asked for."""
        offset, limit = self.page(ALL)
        rows = rows.orderBy(*by)
        rows = rows.offset(offset) if offset else rows
        return [r[0] for r in (rows.limit(limit) if limit < ALL else rows).collect()]


class Session:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, os.path.abspath(folder or os.getcwd())
        self.variables: dict[str, object] = {}
        self.settings, self.seed, self.draws, self.in_script = Settings(), DEFAULT_SEED, 0, False

    def variable(self, name: str):
        if name not in self.variables:
            raise Failure("VariableNotFound", f"No structure is called '{name}'.")
        return self.variables[name]

    def path(self, path: str) -> str:
        path = {"~": os.path.expanduser("~"), "~documents": os.path.join(os.path.expanduser("~"), "Documents")}.get(path, path)
        return path if os.path.isabs(path) or "://" in path else os.path.join(self.folder, path)

    def draw(self) -> int:
        """A fresh seed for each random command of the session."""
        self.draws += 1
        return (self.seed * 1_000_003 + self.draws) & (2**62 - 1)

    def execute(self, cmd: Command) -> Result:
        spec = REGISTRY.get(cmd.name)
        if spec is None:
            return Result(False, "CommandNotFound", f"Unknown command '{cmd.name}'.")
        if spec.makes and not cmd.assign:
            return Result(False, "InvalidSyntax", f"'{cmd.name}' must be assigned to a variable.")
        if cmd.assign and not spec.makes:
            return Result(False, "InvalidSyntax", f"'{cmd.name}' can't be assigned to a variable.")
        try:
            return spec.run(self, Args(self, cmd.args, spec.args), cmd.assign)
        except Failure as e:
            return Result(False, e.code, e.message)

    def run(self, line: str, as_json: bool = False) -> Result:
        cmd = (parse_json if as_json else parse_text)(line)
        if cmd is None:
            return Result(False, "InvalidSyntax", "Invalid command syntax.")
        try:
            return self.execute(cmd)
        except ArgumentError as e:
            return Result(False, "UnhandledException", str(e))

    def assign(self, name: str, value) -> dict[str, str]:
        self.variables[name] = value
        return {name: type(value).__name__}


def ok(message: str = "", payload=None, assigned: dict | None = None) -> Result:
    return Result(True, "OK", message, payload, assigned or {})


def _ids(text: str) -> list[int]:
    return [check_id(x) for x in text.split(";") if x.strip()]


# --- structures ---------------------------------------------------------------------------------------------------


@command("createnodeset", takes("name"), takes("createnodes", "whole number", 0), about="Creates a nodeset, with nodes 0, 1, ... if asked.", makes="nodeset")
def create_nodeset(s: Session, a: Args, to: str) -> Result:
    n = a.maybe("createnodes", 0)
    if n < 0:
        raise Failure("InvalidArgument", "The number of nodes can't be negative.")
    nodes = Nodeset(s.spark, short(a.maybe("name", to)), s.spark.range(n).select(F.col("id").alias("node_id")) if n else None)
    return ok(f"Nodeset '{nodes.name}' created.", None, s.assign(to, nodes))


@command("createnetwork", NODESET, takes("name"), about="Creates a network on a nodeset.", makes="network")
def create_network(s: Session, a: Args, to: str) -> Result:
    network = Network(s.spark, short(a.maybe("name", to)), a.nodeset("nodeset"), s.settings)
    return ok(f"Network '{network.name}' created.", None, s.assign(to, network))


@command("delete", STRUCTURE, about="Deletes a structure that no network needs.")
def delete(s: Session, a: Args, _) -> Result:
    name = a.text("structure")
    found = s.variable(name)
    if any(isinstance(v, Network) and v.nodeset is found for v in s.variables.values()):
        raise Failure("ConstraintNodesetInUse", f"Nodeset '{name}' is used by a network.")
    del s.variables[name]
    return ok(f"'{name}' deleted.")


@command("deleteall", about="Deletes all structures.")
def delete_all(s: Session, a: Args, _) -> Result:
    s.variables.clear()
    return ok("All structures deleted.")


@command("i", about="Lists the structures.")
def inventory(s: Session, a: Args, _) -> Result:
    return ok(f"{len(s.variables)} structure(s).", {k: type(v).__name__ for k, v in s.variables.items()})


@command("info", STRUCTURE, about="Metadata of a structure.")
def info(s: Session, a: Args, _) -> Result:
    x = a.structure()
    out = {"Type": type(x).__name__, "Name": x.name, "Filepath": x.path, "isModified": x.modified}
    if isinstance(x, Nodeset):
        kinds = [{"Name": n, "Type": files.TYPE_NAMES[t]} for n, t in x.attributes.items()]
        return ok(f"Metadata of '{x.name}'.", out | {"NbrNodes": x.df.count(), "NodeAttributes": kinds})
    layers, counts = [], None
    for layer in x.layers.values():
        part = (layer.df if layer.mode == 1 else layer.names.df).agg(F.lit(layer.name).alias("layer"), F.count("*").alias("n"))
        counts = part if counts is None else counts.unionByName(part)
    n = {r["layer"]: r["n"] for r in counts.collect()} if counts is not None else {}
    for layer in x.layers.values():
        entry = {"Name": layer.name, "Mode": layer.mode}
        if layer.mode == 1:
            entry |= {"Directionality": "directed" if layer.directed else "undirected", "ValueType": "valued" if layer.valued else "binary", "Selfties": layer.selfties, "NbrEdges": n[layer.name]}
        else:
            entry |= {"NbrHyperedges": n[layer.name]}
        layers.append(entry)
    return ok(f"Metadata of '{x.name}'.", out | {"Nodeset": x.nodeset.name, "Layers": layers})


@command("preview", STRUCTURE, about="First ten nodes, edges or hyperedges.")
def preview(s: Session, a: Args, _) -> Result:
    x = a.structure()
    if isinstance(x, Nodeset):
        rows = [[v for v in r] for r in x.df.orderBy("node_id").limit(10).collect()]
        return ok(f"Preview of '{x.name}'.", ["\t".join("" if v is None else str(v) for v in r) for r in rows])
    out = {}
    for layer in x.layers.values():
        keys = ("src", "dst") if layer.mode == 1 else ("hyper_name", "node_id")
        out[layer.name] = ["\t".join(map(str, r)) for r in layer.df.orderBy(*keys).limit(10).collect()]
    return ok(f"Preview of '{x.name}'.", out)


# --- nodes --------------------------------------------------------------------------------------------------------


@command("addnode", STRUCTURE, needs("nodeid", "node"), about="Adds a node.")
def add_node(s: Session, a: Args, _) -> Result:
    node = a.node("nodeid")
    a.nodeset().add(node)
    return ok(f"Node {node} added.")


@command("removenode", STRUCTURE, needs("nodeid", "node"), about="Removes a node, and its edges in all networks on the nodeset.")
def remove_node(s: Session, a: Args, _) -> Result:
    nodes, node = a.nodeset(), a.node("nodeid")
    nodes.remove(node)
    for v in s.variables.values():
        if isinstance(v, Network) and v.nodeset is nodes:
            for layer in v.layers.values():
                layer.forget(node)
            v.modified = True
    return ok(f"Node {node} removed.")


@command("getnbrnodes", STRUCTURE, about="Number of nodes.")
def get_nbr_nodes(s: Session, a: Args, _) -> Result:
    return ok("", a.nodeset().df.count())


@command("getallnodes", STRUCTURE, *PAGE, about="Node ids in ascending order, by pages.")
def get_all_nodes(s: Session, a: Args, _) -> Result:
    offset, limit = a.page()
    return ok("", [r[0] for r in a.nodeset().df.select("node_id").orderBy("node_id").offset(offset).limit(limit).collect()])


@command("getnodeidbyindex", STRUCTURE, needs("index", "whole number"), about="The node at a place in ascending order, from 0.")
def get_node_by_index(s: Session, a: Args, _) -> Result:
    k = a.whole("index")
    row = a.nodeset().df.select("node_id").orderBy("node_id").offset(k).limit(1).first() if k >= 0 else None
    if row is None:
        raise Failure("InvalidNodeIndex", f"No node has index {k}.")
    return ok("", row[0])


@command("getrandomnode", STRUCTURE, about="A random node.")
def get_random_node(s: Session, a: Args, _) -> Result:
    row = a.nodeset().df.select("node_id").orderBy(uniform(s.draw(), "node", F.col("node_id"))).first()
    if row is None:
        raise Failure("ConstraintNoNodes", "The nodeset is empty.")
    return ok("", row[0])


# --- attributes ---------------------------------------------------------------------------------------------------


@command("defineattr", STRUCTURE, needs("attrname"), needs("attrtype", "text", "int", "char", "float", "bool"), about="Declares an attribute.")
def define_attr(s: Session, a: Args, _) -> Result:
    a.nodeset().define(a.text("attrname"), a.text("attrtype").lower())
    return ok("Attribute defined.")


@command("undefineattr", STRUCTURE, needs("attrname"), about="Drops an attribute and its values.")
def undefine_attr(s: Session, a: Args, _) -> Result:
    a.nodeset().undefine(a.text("attrname"))
    return ok("Attribute dropped.")


@command("setattr", STRUCTURE, needs("nodeid", "node"), needs("attrname"), needs("attrvalue"), about="Sets a value.")
def set_attr(s: Session, a: Args, _) -> Result:
    a.nodeset().set_value(a.node("nodeid"), a.text("attrname"), a.text("attrvalue"))
    return ok("Attribute set.")


@command("getattr", STRUCTURE, needs("nodeid", "node"), needs("attrname"), about="A value; empty text if it is not set.")
def get_attr(s: Session, a: Args, _) -> Result:
    node, name = a.node("nodeid"), a.text("attrname")
    value = a.nodeset().value(node, name)
    return ok(f"Attribute '{name}' is not set for node {node}." if value is None else "", "" if value is None else value)


@command("getattrs", STRUCTURE, needs("nodes", "nodes"), needs("attrname"), about="Values of several nodes; unknown ids are left out.")
def get_attrs(s: Session, a: Args, _) -> Result:
    nodes, ids, name = a.nodeset(), _ids(a.text("nodes")), a.text("attrname")
    nodes.kind(name)
    rows = nodes.df.where(F.col("node_id").isin(*ids)).select("node_id", F.col(f"`{name}`")).orderBy("node_id").collect() if ids else []
    return ok("", {r[0]: r[1] for r in rows})


@command("removeattr", STRUCTURE, needs("nodeid", "node"), needs("attrname"), about="Unsets a value.")
def remove_attr(s: Session, a: Args, _) -> Result:
    a.nodeset().set_value(a.node("nodeid"), a.text("attrname"), None)
    return ok("Attribute unset.")


@command("generateattr", STRUCTURE, needs("attrname"), takes("attrtype", "text", "int", "int", "float", "bool", "char"), takes("min", "number"), takes("max", "number"), takes("p", "number", 0.5), takes("chars", "text", "m;f;o"), about="Declares an attribute and fills it at random.")
def generate_attr(s: Session, a: Args, _) -> Result:
    name, kind = a.text("attrname"), a.choice("attrtype", "int", tuple(SQL_TYPES))
    low, high = (a.maybe("min", 0), a.maybe("max", 100)) if kind == "int" else (a.maybe("min", 0.0), a.maybe("max", 1.0))
    column = generators.random_attribute(kind, s.draw(), name, low, high, a.maybe("p", 0.5), a.maybe("chars", "m;f;o"))
    a.nodeset().define(name, kind, column)
    return ok("Attribute generated.")


@command("filter", NODESET, needs("attrname"), needs("cond", "text", "eq", "ne", "gt", "lt", "ge", "le", "isnull", "notnull"), takes("attrvalue"), about="Nodes whose attribute satisfies a condition.", makes="nodeset")
def filter_nodes(s: Session, a: Args, to: str) -> Result:
    nodes, name, cond = a.nodeset("nodeset"), a.text("attrname"), a.text("cond")
    kept = nodes.df.where(attribute_condition(name, nodes.kind(name), cond, a.maybe("attrvalue", None)))
    return ok("Nodeset filtered.", None, s.assign(to, Nodeset(s.spark, f"{nodes.name}_clone", kept, nodes.attributes)))


@command("getattrsummary", STRUCTURE, needs("attrname"), about="Statistics of an attribute.")
def get_attr_summary(s: Session, a: Args, _) -> Result:
    nodes, name = a.nodeset(), a.text("attrname")
    kind = nodes.kind(name)
    table = graph.summary(nodes.df, name, kind)
    out: dict = {"AttributeName": name, "AttributeType": files.TYPE_NAMES[kind]}
    if kind == "char":
        rows, total = table.orderBy(F.desc("count"), "first_node").collect(), nodes.df.count()
        n = sum(r["count"] for r in rows)
        stats = {"Count": n, "Missing": total - n, "PercentageWithValue": 100.0 * n / total if total else 0.0}
        stats |= {"Frequency": {r["value"]: r["count"] for r in rows}, "Unique_Values": len(rows)}
        if rows:
            stats |= {"Mode": rows[0]["value"], "Mode_Count": rows[0]["count"]}
        return ok("", out | stats)
    r = table.first()
    stats = {"Count": r["count"], "Missing": r["missing"], "PercentageWithValue": r["percentage"]}
    if kind == "bool":
        stats |= {"Count_True": r["count_true"], "Count_False": r["count_false"], "Ratio_True": r["ratio_true"]}
    elif r["count"]:
        names = {"Mean": "mean", "Median": "median", "StdDev": "stddev", "Min": "min", "Max": "max", "Q1": "q1", "Q3": "q3"}
        stats |= {k: r[v] for k, v in names.items()}
    return ok("", out | stats)


# --- layers and edges ----------------------------------------------------------------------------------------------


@command("addlayer", NETWORK, LAYER, needs("mode", "text", "1", "2"), flag("directed"), takes("valuetype", "text", "binary", "binary", "valued"), flag("selfties"), about="Adds an empty layer.")
def add_layer(s: Session, a: Args, _) -> Result:
    net, name, mode = a.network(), check_name(a.text("layername")), a.text("mode")
    if mode not in ("1", "2"):
        raise Failure("InvalidMode", "A layer has mode 1 or 2.")
    if mode == "1":
        net.add_one_mode(name, a.maybe("directed", False), a.choice("valuetype", "binary", ("binary", "valued")) == "valued", a.maybe("selfties", False))
    else:
        net.add_two_mode(name)
    return ok(f"Layer '{name}' added.")


@command("removelayer", NETWORK, LAYER, about="Removes a layer.")
def remove_layer(s: Session, a: Args, _) -> Result:
    net = a.network()
    del net.layers[net.layer(a.text("layername")).name]
    net.modified = True
    return ok("Layer removed.")


@command("clearlayer", NETWORK, LAYER, about="Removes all edges or hyperedges of a layer.")
def clear_layer(s: Session, a: Args, _) -> Result:
    net = a.network()
    _clear(net.layer(a.text("layername")))
    net.modified = True
    return ok("Layer cleared.")


def _clear(layer) -> None:
    for table in (layer.table, *([layer.names] if layer.mode == 2 else [])):
        table.base, table.waiting, table.empty = table.spark.createDataFrame([], table.schema), [], True


@command("addedge", NETWORK, LAYER, needs("node1id", "node"), needs("node2id", "node"), takes("value", "number", 1.0), flag("addmissingnodes", True), about="Adds an edge.")
def add_edge(s: Session, a: Args, _) -> Result:
    a.network().add_edge(a.text("layername"), a.node("node1id"), a.node("node2id"), a.maybe("value", 1.0), a.maybe("addmissingnodes", True))
    return ok("Edge added.")


@command("removeedge", NETWORK, LAYER, needs("node1id", "node"), needs("node2id", "node"), about="Removes an edge.")
def remove_edge(s: Session, a: Args, _) -> Result:
    a.network().remove_edge(a.text("layername"), a.node("node1id"), a.node("node2id"))
    return ok("Edge removed.")


@command("checkedge", NETWORK, LAYER, needs("node1id", "whole number"), needs("node2id", "whole number"), about="Whether two nodes are tied, or share a hyperedge.")
def check_edge(s: Session, a: Args, _) -> Result:
    net, x, y = a.network(), a.node("node1id"), a.node("node2id")
    layer = net.layer(a.text("layername"))
    net.nodeset.need(x, y)
    return ok("", layer.has(x, y))


@command("getedge", NETWORK, LAYER, needs("node1id", "node"), needs("node2id", "node"), about="Value of an edge (0: none), or number of shared hyperedges.")
def get_edge(s: Session, a: Args, _) -> Result:
    net, x, y = a.network(), a.node("node1id"), a.node("node2id")
    layer = net.layer(a.text("layername"))
    net.nodeset.need(x, y)
    return ok("", layer.value(x, y))


@command("getalledges", NETWORK, LAYER, *PAGE, about="Edges in order, by pages.")
def get_all_edges(s: Session, a: Args, _) -> Result:
    offset, limit = a.page()
    layer = a.network().layer(a.text("layername"), 1)
    edges = layer.df if layer.directed else layer.df.where("src < dst")
    return ok("", [{"node1": r["src"], "node2": r["dst"], "value": r["value"]} for r in edges.orderBy("src", "dst").offset(offset).limit(limit).collect()])


# --- hyperedges ---------------------------------------------------------------------------------------------------


@command("addhyper", NETWORK, LAYER, needs("hypername"), takes("nodes", "nodes"), flag("addmissingnodes", True), about="Adds or replaces a hyperedge.")
def add_hyper(s: Session, a: Args, _) -> Result:
    nodes = a.maybe("nodes", "")
    a.network().add_hyperedge(a.text("layername"), a.text("hypername"), _ids(nodes), a.maybe("addmissingnodes", True))
    return ok("Hyperedge added.")


@command("removehyper", NETWORK, LAYER, needs("hypername"), about="Removes a hyperedge.")
def remove_hyper(s: Session, a: Args, _) -> Result:
    a.network().remove_hyperedge(a.text("layername"), a.text("hypername"))
    return ok("Hyperedge removed.")


@command("addaff", NETWORK, LAYER, needs("nodeid", "node"), needs("hypername"), flag("addmissingnode", True), flag("addmissingaffiliation", True), about="Affiliates a node to a hyperedge.")
def add_aff(s: Session, a: Args, _) -> Result:
    node_too = a.maybe("addmissingnode", a.maybe("addmissingnodes", True))
    hyper_too = a.maybe("addmissingaffiliation", a.maybe("addmissingaffiliations", True))
    a.network().add_affiliation(a.text("layername"), a.node("nodeid"), a.text("hypername"), node_too, hyper_too)
    return ok("Affiliation added.")


@command("removeaff", NETWORK, LAYER, needs("nodeid", "node"), needs("hypername"), about="Ends an affiliation.")
def remove_aff(s: Session, a: Args, _) -> Result:
    a.network().remove_affiliation(a.text("layername"), a.node("nodeid"), a.text("hypername"))
    return ok("Affiliation removed.")


@command("getallhyperedges", NETWORK, LAYER, *PAGE, about="Hyperedge names in order, by pages.")
def get_all_hyperedges(s: Session, a: Args, _) -> Result:
    offset, limit = a.page()
    names = a.network().layer(a.text("layername"), 2).names.df
    return ok("", [r[0] for r in names.orderBy("hyper_name").offset(offset).limit(limit).collect()])


@command("gethyperedgenodes", NETWORK, LAYER, needs("hypername"), *WHOLE, about="Members of a hyperedge.")
def get_hyperedge_nodes(s: Session, a: Args, _) -> Result:
    layer, name = a.network().layer(a.text("layername"), 2), a.text("hypername")
    layer.need_hyperedge(name)
    return ok("", a.listed(layer.df.where(F.col("hyper_name") == name).select("node_id"), "node_id"))


@command("getnodehyperedges", NETWORK, LAYER, needs("nodeid", "node"), *WHOLE, about="Hyperedges of a node.")
def get_node_hyperedges(s: Session, a: Args, _) -> Result:
    net, node = a.network(), a.node("nodeid")
    layer = net.layer(a.text("layername"), 2)
    net.nodeset.need(node)
    return ok("", a.listed(layer.df.where(F.col("node_id") == node).select("hyper_name"), "hyper_name"))


# --- neighbourhood -------------------------------------------------------------------------------------------------

DIRECTIONS = ("both", "in", "out")


@command("getnodealters", NETWORK, needs("nodeid", "node"), takes("layernames", "layers"), takes("direction", "text", "both", "both", "in", "out"), flag("unique", True), *WHOLE, about="Neighbours over layers.")
def get_node_alters(s: Session, a: Args, _) -> Result:
    names = [n.strip() for n in a.maybe("layernames", "").split(";") if n.strip()]
    found = a.network().alters(a.node("nodeid"), names or None, a.choice("direction", "both", DIRECTIONS), a.maybe("unique", True))
    return ok("", a.listed(found.select("alter", "layer"), "layer", "alter"))


@command("getrandomalter", NETWORK, needs("nodeid", "node"), takes("layername"), takes("direction", "text", "both", "both", "in", "out"), flag("balanced"), about="A random neighbour.")
def get_random_alter(s: Session, a: Args, _) -> Result:
    net, node, name = a.network(), a.node("nodeid"), a.maybe("layername", None)
    net.nodeset.need(node)
    layers = [net.layer(name)] if name else list(net.layers.values())
    direction, pool = a.choice("direction", "both", DIRECTIONS), None
    for k, layer in enumerate(layers):
        use = net.out_only(layer, direction)
        if use is not None:
            part = layer.alters(node, use).withColumn("k", F.lit(k))
            pool = part if pool is None else pool.unionByName(part)
    seed = s.draw()
    if pool is not None and not name and a.maybe("balanced", False):  # first a layer that has neighbours, then one of them
        first = pool.select("k").distinct().orderBy(uniform(seed, "layer", F.col("k"))).first()
        pool = pool.where(F.col("k") == first["k"]) if first else pool
    row = pool.orderBy(uniform(seed, "alter", F.col("k"), F.col("alter"))).first() if pool is not None else None
    if row is None:
        raise Failure("ConstraintNoAlters", f"Node {node} has no neighbours.")
    return ok("", row["alter"])


@command("getrandomedge", NETWORK, LAYER, takes("maxattempts", "whole number", 100), about="A random edge, or pair that shares a hyperedge.")
def get_random_edge(s: Session, a: Args, _) -> Result:
    net, seed = a.network(), s.draw()
    layer = net.layer(a.text("layername"))
    if net.nodeset.df.limit(2).count() < 2:
        raise Failure("ConstraintNoNodes", "The nodeset has fewer than two nodes.")
    # only what lies between nodes of the nodeset, as other commands refuse strangers
    if layer.mode == 1:
        row = graph.induced(layer.df, net.nodeset.df).orderBy(uniform(seed, "edge", F.col("src"), F.col("dst"))).first()
        if row is None:
            raise Failure("EdgeNotFound", "The layer has no edges.")
        return ok("", {"node1": row["src"], "node2": row["dst"], "value": row["value"]})
    # a hyperedge by its number of pairs, then two of its members
    members = graph.induced_members(layer.df, net.nodeset.df)
    sizes = members.groupBy("hyper_name").agg(F.count("*").alias("k")).where("k > 1")
    weight = F.col("k") * (F.col("k") - 1) / 2
    hyper = sizes.orderBy(-F.log(uniform(seed, "hyper", F.col("hyper_name")) + F.lit(2.0**-54)) / weight).first()
    if hyper is None:
        raise Failure("EdgeNotFound", "No hyperedge has two members.")
    two = members.where(F.col("hyper_name") == hyper["hyper_name"]).orderBy(uniform(seed, "pair", F.col("node_id"))).limit(2).collect()
    x, y = sorted(r["node_id"] for r in two)
    return ok("", {"node1": x, "node2": y, "value": layer.value(x, y)})


# --- analytics -----------------------------------------------------------------------------------------------------


@command("degree", NETWORK, LAYER, takes("attrname"), takes("direction", "text", "in", "in", "out", "both"), about="Degree of every node, as an attribute.")
def degree(s: Session, a: Args, _) -> Result:
    name = a.network().degree(a.text("layername"), a.maybe("attrname", None), a.choice("direction", "in", DIRECTIONS))
    return ok(f"Degree stored as '{name}'.", name)


@command("density", NETWORK, LAYER, about="Density of a layer.")
def density(s: Session, a: Args, _) -> Result:
    return ok("", a.network().density(a.text("layername")))


@command("components", NETWORK, LAYER, takes("attrname"), *WHOLE, about="Weak components, as an attribute.")
def components(s: Session, a: Args, _) -> Result:
    name, sizes = a.network().components(a.text("layername"), a.maybe("attrname", None))
    return ok(f"Components stored as '{name}'.", {"NbrComponents": sizes.count(), "ComponentSizes": a.listed(sizes.select("count", "component"), F.desc("count"))})


@command("shortestpath", NETWORK, needs("node1id", "node"), needs("node2id", "node"), takes("layername"), about="Steps from one node to another; -1 if there is no way.")
def shortest_path(s: Session, a: Args, _) -> Result:
    return ok("", a.network().path_length(a.node("node1id"), a.node("node2id"), a.maybe("layername", None)))


# --- transforms ----------------------------------------------------------------------------------------------------


@command("symmetrize", NETWORK, LAYER, takes("method", "text", "max", "max", "min", "minnonzero", "average", "sum", "product"), takes("newlayername"), about="Makes an undirected layer of a directed one.")
def symmetrize(s: Session, a: Args, _) -> Result:
    new = a.network().symmetrize(a.text("layername"), a.maybe("method", "max").lower(), a.maybe("newlayername", None))
    return ok("The layer is undirected already." if new is None else f"Layer '{new}' created.", new)


@command("dichotomize", NETWORK, LAYER, takes("cond", "text", "ge", "eq", "ne", "gt", "lt", "ge", "le"), takes("threshold", "number", 1.0), takes("truevalue", "number", 1.0), takes("falsevalue", "number", 0.0), takes("newlayername"), about="Makes a layer by a condition on values.")
def dichotomize(s: Session, a: Args, _) -> Result:
    keep = lambda name, default: None if a.maybe(name, "").lower() == "keep" else a.maybe(name, default)
    new = a.network().dichotomize(
        a.text("layername"), a.maybe("cond", "ge").lower(), a.maybe("threshold", 1.0), keep("truevalue", 1.0), keep("falsevalue", 0.0), a.maybe("newlayername", None)
    )
    return ok(f"Layer '{new}' created.", new)


@command("subnet", NETWORK, NODESET, about="The part of a network among the nodes of a nodeset.", makes="network")
def subnet(s: Session, a: Args, to: str) -> Result:
    net, nodes = a.network(), a.nodeset("nodeset")
    taken, name, k = {v.name for v in s.variables.values()}, f"{net.name}_subnet", 0
    while name in taken:
        k += 1
        name = f"{net.name}_subnet-{k}"
    return ok("Subnetwork created.", None, s.assign(to, net.subnet(nodes, name)))


@command("generate", NETWORK, LAYER, needs("type", "text", "er", "ws", "ba", "2mode"), takes("p", "number"), takes("k", "whole number"), takes("beta", "number"), takes("m", "whole number"), takes("h", "whole number"), takes("a", "whole number"), about="Fills a layer at random.")
def generate(s: Session, a: Args, _) -> Result:
    net, kind = a.network(), a.text("type")
    layer = net.layer(a.text("layername"), 2 if kind == "2mode" else 1)
    nodes, seed = net.nodeset.df, s.draw()

    def number(name: str, cast):
        try:
            return cast(a.text(name))
        except ValueError as e:
            raise ArgumentError(f"Argument '{name}' is needed.") from e

    if kind == "2mode":
        h = number("h", int)
        members = generators.random_two_mode(nodes, h, number("a", int), seed)
        layer.table.set(members)
        layer.names.set(s.spark.range(h).select(F.concat(F.lit("aff_"), F.col("id").cast("string")).alias("hyper_name")))
    elif kind == "er":
        if layer.valued:
            raise Failure("InvalidLayerValueType", "The layer must be binary.")
        layer.table.set(generators.erdos_renyi(nodes, number("p", float), layer.directed, layer.selfties, seed))
    elif kind in ("ws", "ba"):
        if layer.valued or layer.directed or layer.selfties:
            raise Failure("InvalidLayerType", "The layer must be binary, undirected and without self-ties.")
        if kind == "ws":
            edges = generators.watts_strogatz(nodes, number("k", int), number("beta", float), seed)
            layer.table.set(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "value"))
        else:  # added to what the layer holds
            edges = generators.barabasi_albert(nodes, number("m", int), seed)
            layer.table.set(layer.df.unionByName(edges).dropDuplicates(["src", "dst"]))
    else:
        raise Failure("InvalidArgument", f"Unknown type '{kind}'.")
    net.modified = True
    return ok("Layer generated.")


# --- files ---------------------------------------------------------------------------------------------------------


@command("loadfile", needs("file"), needs("type", "text", "nodeset", "network"), about="Loads a structure; a network brings its nodeset as <var>_nodeset.", makes="structure")
def load_file(s: Session, a: Args, to: str) -> Result:
    path, kind = s.path(a.text("file")), a.text("type").lower()
    if kind == "nodeset":
        return ok("Nodeset loaded.", None, s.assign(to, files.read_nodeset(s.spark, path)))
    if kind != "network":
        raise Failure("UnsupportedStructureType", f"'{kind}' can't be loaded.")
    network, nodes = files.read_network(s.spark, path, s.settings, s.path)
    return ok("Network loaded.", None, s.assign(to, network) | s.assign(f"{to}_nodeset", nodes))


@command("savefile", STRUCTURE, takes("file"), about="Saves a structure, in the format its file name tells.")
def save_file(s: Session, a: Args, _) -> Result:
    x = a.structure()
    path = a.maybe("file", None)
    path = s.path(path) if path else x.path
    if not path:
        raise Failure("MissingFilepath", "The structure has no file yet.")
    try:
        (files.write_nodeset if isinstance(x, Nodeset) else files.write_network)(x, path)
    except OSError as e:
        raise Failure("IOSaveError", str(e)) from e
    return ok(f"Saved as '{path}'.")


@command("importlayer", NETWORK, LAYER, needs("file"), needs("format", "text", "edgelist", "matrix"), takes("node1col", "whole number", 0), takes("node2col", "whole number", 1), takes("valuecol", "whole number", 2), takes("nodecol", "whole number", 0), takes("affcol", "whole number", 1), flag("header"), takes("sep", "character", "\t"), flag("addmissingnodes"), about="Imports an edge list or matrix.")
def import_layer(s: Session, a: Args, _) -> Result:
    edgelists.import_layer(
        a.network(), a.text("layername"), s.path(a.text("file")), a.text("format").lower(), col1=a.maybe("node1col", 0), col2=a.maybe("node2col", 1),
        value_col=a.maybe("valuecol", 2), node_col=a.maybe("nodecol", 0), aff_col=a.maybe("affcol", 1), header=a.maybe("header", False),
        sep=a.maybe("sep", "\t").replace("\\t", "\t"), add_missing=a.maybe("addmissingnodes", False),
    )
    return ok("Layer imported.")


@command("exportlayer", NETWORK, LAYER, needs("file"), flag("header", True), takes("sep", "character", "\t"), about="Exports a layer as an edge list.")
def export_layer(s: Session, a: Args, _) -> Result:
    edgelists.export_layer(a.network(), a.text("layername"), s.path(a.text("file")), a.maybe("header", True), a.maybe("sep", "\t").replace("\\t", "\t"))
    return ok("Layer exported.")


# --- environment ---------------------------------------------------------------------------------------------------


@command("getwd", about="The working directory.")
def getwd(s: Session, a: Args, _) -> Result:
    return ok("", s.folder)


@command("setwd", needs("dir"), about="Changes the working directory.")
def setwd(s: Session, a: Args, _) -> Result:
    path = s.path(a.text("dir"))
    if not os.path.isdir(path):
        raise Failure("DirectoryNotFound", f"Directory '{path}' not found.")
    s.folder = os.path.abspath(path)
    return ok("", s.folder)


@command("dir", takes("path"), about="Lists a directory.")
def list_dir(s: Session, a: Args, _) -> Result:
    path = s.path(a.maybe("path", "."))
    if not os.path.isdir(path):
        raise Failure("DirectoryNotFound", f"Directory '{path}' not found.")
    entries = sorted(os.scandir(path), key=lambda e: e.name)
    dirs, plain = [e.name for e in entries if e.is_dir()], [e.name for e in entries if e.is_file()]
    return ok("", {"Path": path, "Directories": dirs, "Files": plain, "TotalDirectories": len(dirs), "TotalFiles": len(plain)})


@command("setting", needs("name"), needs("value", "text", "true", "false"), about="Changes a setting: verbose, nodecache, blockmultiedges or onlyoutboundedges.")
def setting(s: Session, a: Args, _) -> Result:
    name, value = a.text("name").lower(), a.text("value").lower()
    if not hasattr(s.settings, name):
        raise Failure("SettingNotFound", f"There is no setting '{name}'.")
    if value not in ("true", "false"):
        raise Failure("InvalidArgument", "A setting is true or false.")
    setattr(s.settings, name, value == "true")
    return ok(f"{name} = {value}.")


@command("randomseed", takes("seed", "whole number", DEFAULT_SEED), about="Sets the seed of random commands.")
def random_seed(s: Session, a: Args, _) -> Result:
    s.seed, s.draws = a.maybe("seed", DEFAULT_SEED), 0
    return ok(f"Seed {s.seed}.", s.seed)


@command("loadscript", needs("file"), about="Runs the commands of a text file until one fails.")
def load_script(s: Session, a: Args, _) -> Result:
    if s.in_script:
        return ok("A script does not load another one; skipped.")
    path = s.path(a.text("file"))
    if not os.path.isfile(path):
        raise Failure("FileNotFound", f"File '{path}' not found.")
    with open(path, encoding="utf-8-sig") as f:
        lines = f.read().splitlines()
    payload, assigned = {}, {}
    s.in_script = True
    try:
        for n, line in enumerate(lines, 1):
            if not line.strip() or line.strip().startswith("#"):
                continue
            r = s.run(line)
            if not r.success:
                return Result(False, "InvalidSyntax", f"{r.code}: {r.message} (line {n})", payload, assigned)
            if r.payload is not None:
                payload[f"[{n}] {parse_text(line).name}"] = r.payload
            assigned |= r.assigned
    finally:
        s.in_script = False
    return ok("Script ended.", payload, assigned)


@command("help", takes("command"), takes("file"), about="Lists the commands, or explains one; file= writes the list to a file.")
def help_(s: Session, a: Args, _) -> Result:
    name = a.raw("command")
    if path := a.args.get("file"):
        files.write_lines(s.path(path), (f"{k}\t{v.syntax}\t{v.about}" for k, v in sorted(REGISTRY.items())))
        return ok("Help written.")
    if name is None:
        return ok("", {k: v.syntax for k, v in sorted(REGISTRY.items())})
    if name.lower() not in REGISTRY:
        raise Failure("CommandNotFound", f"Unknown command '{name}'.")
    spec = REGISTRY[name.lower()]
    return ok("", {"Syntax": spec.syntax, "Description": spec.about, "Arguments": [x.described() for x in spec.args]})


# --- front end -----------------------------------------------------------------------------------------------------


def render_json(result: Result, verbose: bool = True) -> str:
    return json.dumps(result.as_dict(verbose), default=str)


def render_text(result: Result, verbose: bool = True) -> str:
    """Code and message of failures, otherwise the payload, nested values indented."""
    if not result.success:
        return f"{result.code}: {result.message}"

    def show(x, depth: int) -> list[str]:
        pad = "  " * depth
        if isinstance(x, dict):
            out = []
            for k, v in x.items():
                out += [f"{pad}{k}:", *show(v, depth + 1)] if isinstance(v, dict) or isinstance(v, list) and v and isinstance(v[0], dict) else [f"{pad}{k}: {flat(v)}"]
            return out
        if isinstance(x, list) and x and isinstance(x[0], dict):
            return [f"{pad}- " + ", ".join(f"{k}={flat(v)}" for k, v in r.items()) for r in x]
        return [pad + flat(x)]

    def flat(x) -> str:
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, list):
            return "[" + ", ".join(flat(v) for v in x) + "]"
        return "" if x is None else str(x)

    parts = [result.message] if verbose and result.message else []
    if result.payload is not None:
        parts += show(result.payload, 0)
    return "\n".join(parts)


def loop(spark: SparkSession, lines=None, as_json: bool = False, silent: bool = False, out=None) -> None:
    """Reads commands until `exit` or the end; one result for each."""
    session, out = Session(spark), out or sys.stdout
    session.settings.verbose = not silent
    for line in lines if lines is not None else sys.stdin:
        if not line.strip() or line.strip().startswith("#"):
            continue
        if line.strip() == "exit":
            break
        result = session.run(line.strip(), as_json)
        render = render_json if as_json else render_text
        print(render(result, session.settings.verbose), file=out if result.success or as_json else sys.stderr, flush=True)


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    spark = SparkSession.builder.appName("netloom").getOrCreate()
    loop(spark, as_json=bool({"-j", "--json"} & set(argv)), silent=bool({"-s", "--silent"} & set(argv)))


if __name__ == "__main__":
    main()
