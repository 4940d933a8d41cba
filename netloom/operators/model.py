"""Handles of nodesets, layers and networks.  Data is in DataFrames; small changes wait in a buffer on the driver.

A read folds the buffer in as one local relation; every FOLDS folds the lineage is cut.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.conditions import NODE_MAX, SQL_TYPES, parse_value
from netloom.functions.errors import Failure
from netloom.functions.tables import cut
from netloom.operators import graph

FOLDS = 12


class Table:
    """A DataFrame with rows waiting to be added."""

    def __init__(self, spark: SparkSession, schema: str, df: DataFrame | None = None):
        self.spark, self.schema = spark, schema
        self.empty = df is None
        self.base = spark.createDataFrame([], schema) if df is None else df
        self.waiting: list[tuple] = []
        self.folds = 0

    @property
    def df(self) -> DataFrame:
        if self.waiting:
            fresh = self.spark.createDataFrame(self.waiting, self.schema)
            self.base = fresh if self.empty else self.base.unionByName(fresh)
            self.empty, self.waiting = False, []
            self._folded()
        return self.base

    def _folded(self) -> None:
        self.folds += 1
        if self.folds % FOLDS == 0:
            self.base = cut(self.base)

    def add(self, row: tuple) -> None:
        self.waiting.append(row)

    def set(self, df: DataFrame) -> None:
        self.base, self.waiting, self.empty = df, [], False
        self._folded()

    def keep(self, condition: Column) -> None:
        self.set(self.df.where(condition))

    def has(self, row_test, condition: Column) -> bool:
        if any(row_test(r) for r in self.waiting):
            return True
        return not self.empty and not self.base.where(condition).isEmpty()


def check_name(name: str, code: str = "InvalidLayerName") -> str:
    name = name.strip()
    if not re.fullmatch(r"[^\W\d_]\w*", name):
        raise Failure(code, f"'{name}' is not a valid name: a letter, then letters, digits and underscores.")
    return short(name)


def short(name: str) -> str:
    if len(name.encode()) > 255:
        raise Failure("NameTooLong", "Names have at most 255 bytes.")
    return name


def check_id(value) -> int:
    try:
        node = int(str(value).strip())
    except ValueError:
        node = -1
    if not 0 <= node <= NODE_MAX:
        raise Failure("InvalidArgument", f"'{value}' is not a node id.")
    return node


class Nodeset:
    """nodes(node_id, one column per attribute, null where unset)."""

    def __init__(self, spark: SparkSession, name: str, df: DataFrame | None = None, attributes: dict[str, str] | None = None, path: str = ""):
        self.spark, self.name, self.path = spark, name, path
        self.attributes = dict(attributes or {})
        self.modified = False
        self.table = Table(spark, self._schema(), df)

    def _schema(self) -> str:
        return ", ".join(["node_id long", *[f"`{a}` {SQL_TYPES[t]}" for a, t in self.attributes.items()]])

    @property
    def df(self) -> DataFrame:
        return self.table.df

    def changed(self) -> None:
        self.modified = True

    def has(self, node: int) -> bool:
        return self.table.has(lambda r: r[0] == node, F.col("node_id") == node)

    def need(self, *nodes: int) -> None:
        if missing := sorted(set(nodes) - set(self.held(list(nodes)))):
            raise Failure("NodeNotFound", f"Node {', '.join(map(str, missing))} not found in nodeset '{self.name}'.")

    def add(self, node: int) -> None:
        if self.has(node):
            raise Failure("NodeAlreadyExists", f"Node {node} already exists in nodeset '{self.name}'.")
        self._append(node)

    def _append(self, node: int) -> None:
        self.table.add((node, *[None] * len(self.attributes)))
        self.changed()

    def held(self, nodes: list[int]) -> list[int]:
        """Those of the ids that are nodes, by one job whatever their number."""
        wanted = set(nodes)
        there = wanted & {r[0] for r in self.table.waiting}
        if rest := wanted - there:
            there |= {r[0] for r in self.table.base.where(F.col("node_id").isin(*rest)).select("node_id").collect()}
        return sorted(there)

    def ensure(self, nodes: list[int]) -> None:
        for node in sorted(set(nodes) - set(self.held(nodes))):
            self._append(node)

    def ensure_all(self, ids: DataFrame) -> None:
        """Adds the ids (column node_id) that are missing, in one pass."""
        fresh = ids.select("node_id").distinct().join(self.df.select("node_id"), "node_id", "left_anti")
        for a, t in self.attributes.items():
            fresh = fresh.withColumn(a, F.lit(None).cast(SQL_TYPES[t]))
        self.table.set(cut(self.df.unionByName(fresh)))
        self.changed()

    def kind(self, attribute: str) -> str:
        if attribute not in self.attributes:
            raise Failure("AttributeUnknown", f"Attribute '{attribute}' is not defined in nodeset '{self.name}'.")
        return self.attributes[attribute]

    def define(self, attribute: str, kind: str, column: Column | None = None) -> None:
        attribute = check_name(attribute, "InvalidAttributeName")
        if kind not in SQL_TYPES:
            raise Failure("InvalidAttributeType", f"'{kind}' is not an attribute type.")
        if attribute in self.attributes or attribute == "node_id":
            raise Failure("AttributeAlreadyExists", f"Attribute '{attribute}' already exists.")
        value = (F.lit(None) if column is None else column).cast(SQL_TYPES[kind])
        df = self.df.withColumn(attribute, value)
        self.attributes[attribute] = kind
        self.table.schema = self._schema()
        self.table.set(df)
        self.changed()

    def undefine(self, attribute: str) -> None:
        self.kind(attribute)
        df = self.df.drop(attribute)
        del self.attributes[attribute]
        self.table.schema = self._schema()
        self.table.set(df)
        self.changed()

    def set_value(self, node: int, attribute: str, text: str | None) -> None:
        """text None unsets."""
        kind = self.kind(attribute)
        value = None
        if text is not None and (value := parse_value(text, kind)) is None:
            raise Failure("ParseAttributeValueError", f"'{text}' is not a value of type {kind}.")
        self.need(node)
        literal = F.lit(value).cast(SQL_TYPES[kind])
        self.table.set(self.df.withColumn(attribute, F.when(F.col("node_id") == node, literal).otherwise(F.col(f"`{attribute}`"))))
        self.changed()

    def set_values(self, attribute: str, kind: str, values: DataFrame) -> None:
        """values(node_id, value): defines the attribute if new, overwrites where given; strangers are skipped."""
        if self.attributes.get(attribute, kind) != kind:
            raise Failure("ConstraintAttributeTypeMismatch", f"Attribute '{attribute}' has another type.")
        if attribute not in self.attributes:
            self.define(attribute, kind)
        new = values.select("node_id", F.col("value").cast(SQL_TYPES[kind]).alias("new_"))
        joined = self.df.join(new, "node_id", "left")
        self.table.set(joined.withColumn(attribute, F.coalesce("new_", F.col(f"`{attribute}`"))).drop("new_"))
        self.changed()

    def value(self, node: int, attribute: str):
        self.kind(attribute)
        row = self.df.where(F.col("node_id") == node).select(F.col(f"`{attribute}`")).first()
        if row is None:
            raise Failure("NodeNotFound", f"Node {node} not found in nodeset '{self.name}'.")
        return row[0]

    def remove(self, node: int) -> None:
        self.need(node)
        self.table.keep(F.col("node_id") != node)
        self.changed()


@dataclass
class OneMode:
    """edges(src, dst, value); undirected ones once, with src <= dst."""

    name: str
    directed: bool
    valued: bool
    selfties: bool
    table: Table
    mode: int = 1

    @property
    def df(self) -> DataFrame:
        return self.table.df

    def key(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.directed else (min(a, b), max(a, b))

    def at(self, a: int, b: int) -> Column:
        a, b = self.key(a, b)
        return (F.col("src") == a) & (F.col("dst") == b)

    def has(self, a: int, b: int) -> bool:
        key = self.key(a, b)
        return self.table.has(lambda r: r[:2] == key, self.at(a, b))

    def value(self, a: int, b: int) -> float:
        row = self.df.where(self.at(a, b)).select(F.min("value")).first()
        return float(row[0]) if row[0] is not None else 0.0

    def alters(self, ego: int, direction: str) -> DataFrame:
        return graph.alters(self.df, self.directed, ego, direction)

    def forget(self, node: int) -> None:
        self.table.keep((F.col("src") != node) & (F.col("dst") != node))


@dataclass
class TwoMode:
    """members(hyper_name, node_id), and names, which keep hyperedges without members."""

    name: str
    table: Table
    names: Table
    mode: int = 2

    @property
    def df(self) -> DataFrame:
        return self.table.df

    def has_hyperedge(self, hyper: str) -> bool:
        return self.names.has(lambda r: r[0] == hyper, F.col("hyper_name") == hyper)

    def need_hyperedge(self, hyper: str) -> None:
        if not self.has_hyperedge(hyper):
            raise Failure("HyperedgeNotFound", f"Hyperedge '{hyper}' not found in layer '{self.name}'.")

    def is_member(self, hyper: str, node: int) -> bool:
        return self.table.has(lambda r: r == (hyper, node), (F.col("hyper_name") == hyper) & (F.col("node_id") == node))

    def value(self, a: int, b: int) -> float:
        return float(graph.shared_hyperedges(self.df, a, b).count())

    def has(self, a: int, b: int) -> bool:
        return self.value(a, b) > 0

    def alters(self, ego: int, direction: str) -> DataFrame:
        return graph.alters_two_mode(self.df, ego)

    def forget(self, node: int) -> None:
        self.table.keep(F.col("node_id") != node)


@dataclass
class Settings:
    verbose: bool = True
    nodecache: bool = True
    blockmultiedges: bool = True
    onlyoutboundedges: bool = False


@dataclass
class Network:
    spark: SparkSession
    name: str
    nodeset: Nodeset
    settings: Settings = field(default_factory=Settings)
    path: str = ""
    modified: bool = False
    layers: dict = field(default_factory=dict)

    def layer(self, name: str, mode: int | None = None):
        name = name.strip()
        if name not in self.layers:
            raise Failure("LayerNotFound", f"Layer '{name}' not found in network '{self.name}'.")
        layer = self.layers[name]
        if mode and layer.mode != mode:
            raise Failure("InvalidLayerMode", f"Layer '{name}' is not {mode}-mode.")
        return layer

    def free_name(self, wanted: str) -> str:
        name, k = wanted, 0
        while name in self.layers:
            k += 1
            name = f"{wanted}-{k}"
        return name

    def _new(self, name: str) -> None:
        if name in self.layers:
            raise Failure("LayerAlreadyExists", f"Layer '{name}' already exists in network '{self.name}'.")
        self.modified = True

    def add_one_mode(self, name: str, directed: bool, valued: bool, selfties: bool, edges: DataFrame | None = None) -> OneMode:
        self._new(name)
        self.layers[name] = OneMode(name, directed, valued, selfties, Table(self.spark, "src long, dst long, value float", edges))
        return self.layers[name]

    def add_two_mode(self, name: str, members: DataFrame | None = None, names: DataFrame | None = None) -> TwoMode:
        self._new(name)
        if members is not None and names is None:
            names = members.select("hyper_name").distinct()
        layer = TwoMode(name, Table(self.spark, "hyper_name string, node_id long", members), Table(self.spark, "hyper_name string", names))
        self.layers[name] = layer
        return layer

    def add_edge(self, name: str, a: int, b: int, value: float = 1.0, add_missing: bool = True) -> None:
        layer = self.layer(name, 1)
        if not layer.valued:
            value = 1.0 if value > 0 else 0.0
        if value == 0:
            return
        if not add_missing:
            self.nodeset.need(a, b)
        if a == b and not layer.selfties:
            raise Failure("ConstraintSelftiesNotAllowed", f"Layer '{name}' has no self-ties.")
        if self.settings.blockmultiedges and layer.has(a, b):
            raise Failure("EdgeAlreadyExists", f"Edge {a}-{b} already exists in layer '{name}'.")
        if add_missing:
            self.nodeset.ensure([a, b])
        layer.table.add((*layer.key(a, b), float(value)))
        self.modified = True

    def remove_edge(self, name: str, a: int, b: int) -> None:
        layer = self.layer(name, 1)
        self.nodeset.need(a, b)
        hit = layer.df.where(layer.at(a, b)).limit(2).collect()
        if not hit:
            raise Failure("EdgeNotFound", f"Edge {a}-{b} not found in layer '{name}'.")
        if self.settings.blockmultiedges:
            layer.table.keep(~layer.at(a, b))
        else:  # one of several copies goes
            copies = layer.df.where(layer.at(a, b)).select("src", "dst", "value").collect()
            layer.table.keep(~layer.at(a, b))
            for r in copies[1:]:
                layer.table.add(tuple(r))
        self.modified = True

    def add_hyperedge(self, name: str, hyper: str, nodes: list[int], add_missing: bool = True) -> None:
        layer = self.layer(name, 2)
        hyper = short(hyper)
        if add_missing:
            self.nodeset.ensure(sorted(set(nodes)))
            kept = sorted(set(nodes))
        else:
            kept = self.nodeset.held(nodes)
        if layer.has_hyperedge(hyper):
            layer.table.keep(F.col("hyper_name") != hyper)
        else:
            layer.names.add((hyper,))
        for n in kept:
            layer.table.add((hyper, n))
        self.modified = True

    def remove_hyperedge(self, name: str, hyper: str) -> None:
        layer = self.layer(name, 2)
        layer.need_hyperedge(hyper)
        layer.table.keep(F.col("hyper_name") != hyper)
        layer.names.keep(F.col("hyper_name") != hyper)
        self.modified = True

    def add_affiliation(self, name: str, node: int, hyper: str, add_node: bool = True, add_hyper: bool = True) -> None:
        layer = self.layer(name, 2)
        if add_node:
            self.nodeset.ensure([node])
        else:
            self.nodeset.need(node)
        if not layer.has_hyperedge(hyper):
            if not add_hyper:
                raise Failure("HyperedgeNotFound", f"Hyperedge '{hyper}' not found in layer '{name}'.")
            layer.names.add((short(hyper),))
        if not layer.is_member(hyper, node):
            layer.table.add((hyper, node))
        self.modified = True

    def remove_affiliation(self, name: str, node: int, hyper: str) -> None:
        layer = self.layer(name, 2)
        self.nodeset.need(node)
        layer.need_hyperedge(hyper)
        if not layer.is_member(hyper, node):
            raise Failure("ConstraintNodeNotAffiliated", f"Node {node} is not affiliated to '{hyper}'.")
        layer.table.keep(~((F.col("hyper_name") == hyper) & (F.col("node_id") == node)))
        self.modified = True

    def out_only(self, layer, direction: str) -> str | None:
        """Direction to read under the outbound-only setting; None: nothing."""
        if self.settings.onlyoutboundedges and layer.mode == 1 and layer.directed:
            return None if direction == "in" else "out"
        return direction

    def alters(self, ego: int, names: list[str] | None, direction: str, unique: bool) -> DataFrame:
        """(layer, alter): neighbours over layers by their place, named layers repeated if named twice; unique: each once, with layer 0."""
        self.nodeset.need(ego)
        layers = [self.layer(n) for n in names] if names else list(self.layers.values())
        out = self.spark.createDataFrame([], "layer int, alter long")
        for k, layer in enumerate(layers):
            use = self.out_only(layer, direction)
            if use is not None:
                out = out.unionByName(layer.alters(ego, use).select(F.lit(0 if unique else k).alias("layer"), "alter"))
        return out.distinct() if unique else out

    def pairs(self, layer) -> DataFrame:
        """(src, dst) that connect, for components."""
        return layer.df.select("src", "dst") if layer.mode == 1 else graph.bipartite(layer.df)

    def path_length(self, a: int, b: int, name: str | None) -> int:
        self.nodeset.need(a, b)
        layers = [self.layer(name)] if name else list(self.layers.values())
        if a == b:
            return 0
        if not layers:
            return -1
        steps = [graph.step_one_mode(x.df, x.directed) if x.mode == 1 else graph.step_two_mode(x.df) for x in layers]
        start = self.spark.createDataFrame([(a,)], "node_id long")
        return graph.distances(start, steps, target=b)[1]

    def degree(self, name: str, attribute: str | None, direction: str) -> str:
        layer = self.layer(name)
        if layer.mode == 2 or not layer.directed:
            default = f"{name}_degree"
        else:
            default = f"{name}_{ {'in': 'indegree', 'out': 'outdegree', 'both': 'grossdegree'}[direction]}"
        attribute = attribute or re.sub(r"\W", "_", default)
        if layer.mode == 2:
            values = graph.two_mode_degree(self.nodeset.df, layer.df)
        elif self.settings.onlyoutboundedges and layer.directed and direction == "in":
            values = self.nodeset.df.select("node_id", F.lit(0).alias("degree"))
        else:
            use = self.out_only(layer, direction)
            values = graph.degree(self.nodeset.df, layer.df, layer.directed, use)
        self.nodeset.set_values(attribute, "int", values.withColumnRenamed("degree", "value"))
        return attribute

    def density(self, name: str) -> float:
        layer = self.layer(name)
        if layer.mode == 2:
            return float(graph.two_mode_density(self.nodeset.df, layer.df).first()["density"])
        return float(graph.density(self.nodeset.df, layer.df, layer.directed, layer.selfties).first()["density"])

    def components(self, name: str, attribute: str | None) -> tuple[str, DataFrame]:
        """Name of the attribute and (component, count)."""
        layer = self.layer(name)
        attribute = attribute or re.sub(r"\W", "_", f"{name}_componentIndex")
        values = cut(graph.components(self.nodeset.df, self.pairs(layer)))
        self.nodeset.set_values(attribute, "int", values.withColumnRenamed("component", "value"))
        return attribute, values.groupBy("component").count()

    def symmetrize(self, name: str, method: str, new: str | None) -> str | None:
        """Name of the new layer; None if the layer is undirected already."""
        layer = self.layer(name, 1)
        if method not in graph.SYMMETRIZERS:
            raise Failure("InvalidArgument", f"Unknown method '{method}'.")
        if not layer.directed:
            return None
        new = new or self.free_name(f"{name}-symmetrized")
        self.add_one_mode(new, False, layer.valued, layer.selfties, graph.symmetrize(layer.df, method, layer.valued))
        return new

    def dichotomize(self, name: str, cond: str, threshold: float, true_value: float | None, false_value: float | None, new: str | None) -> str:
        layer = self.layer(name, 1)
        if not layer.valued:
            raise Failure("ConstraintLayerAlreadyBinary", f"Layer '{name}' is binary.")
        if cond not in ("eq", "ne", "gt", "lt", "ge", "le"):
            raise Failure("InvalidCondition", f"Condition '{cond}' can't be used here.")
        edges, valued = graph.dichotomize(layer.df, cond, threshold, true_value, false_value)
        new = new or self.free_name(f"{name}-dichotomized")
        self.add_one_mode(new, layer.directed, valued, layer.selfties, edges)
        return new

    def subnet(self, nodeset: Nodeset, name: str) -> Network:
        out = Network(self.spark, name, nodeset, self.settings, modified=True)
        for layer in self.layers.values():
            if layer.mode == 1:
                out.add_one_mode(layer.name, layer.directed, layer.valued, layer.selfties, graph.induced(layer.df, nodeset.df))
            else:
                out.add_two_mode(layer.name, graph.induced_members(layer.df, nodeset.df))
        return out
