"""Queries of the network operators over the test tables, whole, and the SQL that says the same.

Nodes: the register, one row per node (its first registration).  Arcs: all directed layers as one, the first row of a pair
counts.  Ties: all undirected layers as one, a label's digits are its node.  Members: all 2-mode layers as one,
a hyperedge is named layer/affiliation.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from netloom.functions.chance import DEFAULT_SEED, uniform
from netloom.functions.conditions import attribute_condition
from netloom.functions.tables import checkpoint_folder, cut, table, written
from netloom.operators import generators, graph
from netloom.operators.model import Network, Nodeset
from netloom.sources import edgelists, files

KINDS = {"Status": "char", "Gender": "char", "Office": "char", "Practice": "char", "LawSchool": "char", "YearsWithFirm": "int", "Age": "int"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lazega_nodes").where("node_id is not null")
    first = rows.groupBy("node_id").agg(F.min(F.struct("rec_id", *KINDS, "deleted_at")).alias("r"))
    return first.select("node_id", *[f"r.{k}" for k in KINDS], F.col("r.deleted_at").isNotNull().alias("Deleted"))


def arcs_of(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "trade_edges").select("row_id", F.col("from").alias("src"), F.col("to").alias("dst"), "value").dropna().where("value <> 0")
    return rows.groupBy("src", "dst").agg(F.min_by("value", "row_id").alias("value"))


def ties_of(spark: SparkSession, d: str) -> DataFrame:
    number = lambda c: F.regexp_replace(c, "[^0-9]", "").try_cast("long")
    rows = table(spark, d, "call_edges").select("row_id", number("node1").alias("a"), number("node2").alias("b"), F.col("value").cast("float").alias("value")).dropna()
    rows = rows.where("value <> 0").select("row_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "value")
    return rows.groupBy("src", "dst").agg(F.min_by("value", "row_id").alias("value"))


def members_of(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "affiliations").select("layer", "affiliation", F.col("node").alias("node_id")).dropna()
    return rows.select(F.concat_ws("/", "layer", "affiliation").alias("hyper_name"), "node_id").distinct()


def parts_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), "p_size", F.col("p_retailprice").cast("float").alias("price"), F.col("p_brand").alias("brand"))


def orders_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("hyper_name"), F.col("l_partkey").alias("node_id")).distinct()


def next_of(spark: SparkSession, d: str) -> DataFrame:
    """Arcs between successive users of the event table, valued by how often.

    The global order is made by ranges, so successors meet in a join on their number rather than in one task.
    """
    events = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"))
    ranked = graph.numbered(events, "at", "k")
    after = ranked.select((F.col("k") - 1).alias("k"), F.col("user_id").alias("dst"))
    pairs = ranked.select("k", F.col("user_id").alias("src")).join(after, "k")
    return pairs.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("float").alias("value"))


_NODES = "nodes as (select * exclude (rn, deleted_at), deleted_at is not null as Deleted from (select node_id, Status, Gender, Office, Practice, LawSchool, YearsWithFirm, Age, deleted_at, row_number() over (partition by node_id order by rec_id) as rn from lazega_nodes where node_id is not null) where rn = 1)"
_ARCS = """arcs as (select src, dst, value from (select "from" as src, "to" as dst, value, row_number() over (partition by "from", "to" order by row_id) as rn
  from trade_edges where "from" is not null and "to" is not null and value is not null and value <> 0) where rn = 1)"""
_TIES = """digits as (select row_id, try_cast(regexp_replace(node1, '[^0-9]', '', 'g') as bigint) as a, try_cast(regexp_replace(node2, '[^0-9]', '', 'g') as bigint) as b, cast(value as float) as value from call_edges),
ties as (select src, dst, value from (select least(a, b) as src, greatest(a, b) as dst, value, row_number() over (partition by least(a, b), greatest(a, b) order by row_id) as rn
  from digits where a is not null and b is not null and value is not null and value <> 0) where rn = 1),
both_ways as (select src, dst, value from ties union all select dst, src, value from ties where src <> dst)"""
_MEMBERS = "members as (select distinct layer || '/' || affiliation as hyper_name, node as node_id from affiliations where layer is not null and affiliation is not null and node is not null)"
_NEXT = "nx as (select src, dst, cast(count(*) as float) as value from (select user_id as src, lead(user_id) over (order by ts, event_id) as dst from events) where dst is not null and src <> dst group by src, dst)"


def add(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        SQL[name] = sql


def doubled(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("value").cast("double"))


# degree
for _direction, _count in (("in", "count(a.dst)"), ("out", "count(a.dst)"), ("both", "count(a.dst)")):
    _on = {"in": "n.node_id = a.dst", "out": "n.node_id = a.src"}.get(_direction)
    if _on:
        _sql = f"with {_NODES}, {_ARCS} select n.node_id, cast(count(a.dst) as integer) as degree from nodes n left join arcs a on {_on} group by n.node_id"
    else:
        _sql = f"with {_NODES}, {_ARCS}, ends as (select src as e from arcs union all select dst from arcs) select n.node_id, cast(count(e) as integer) as degree from nodes n left join ends on e = n.node_id group by n.node_id"
    add(f"n_degree_{_direction}", lambda s, d, k=_direction: graph.degree(nodes_of(s, d), arcs_of(s, d), True, k), _sql)
add(
    "n_degree_undirected",
    lambda s, d: graph.degree(nodes_of(s, d), ties_of(s, d), False),
    f"with {_NODES}, {_TIES} select n.node_id, cast(count(b.dst) as integer) as degree from nodes n left join both_ways b on n.node_id = b.src group by n.node_id",
)
_TWO_MODE = """select n.node_id, cast(count(distinct y.node_id) as integer) as degree from nodes n left join members x on n.node_id = x.node_id
  left join members y on x.hyper_name = y.hyper_name and y.node_id <> x.node_id group by n.node_id"""
add("n_degree_two_mode", lambda s, d: graph.two_mode_degree(nodes_of(s, d), members_of(s, d)), f"with {_NODES}, {_MEMBERS} {_TWO_MODE}")
add(
    "n_degree_orders",
    lambda s, d: graph.two_mode_degree(parts_of(s, d), orders_of(s, d)),
    f"with nodes as (select p_partkey as node_id from part), members as (select distinct l_orderkey as hyper_name, l_partkey as node_id from lineitem) {_TWO_MODE}",
)

# density
add(
    "n_density_directed",
    lambda s, d: graph.density(nodes_of(s, d), arcs_of(s, d), True, True),
    f"with {_NODES}, {_ARCS}, n as (select count(*) as n from nodes), e as (select count(*) as edges from arcs) select edges, n * n as potential, edges / (n * n)::double as density from n, e",
)
add(
    "n_density_undirected",
    lambda s, d: graph.density(nodes_of(s, d), ties_of(s, d), False, False),
    f"with {_NODES}, {_TIES}, n as (select count(*) as n from nodes), e as (select count(*) as edges from ties) select edges, n * (n - 1) // 2 as potential, edges / (n * (n - 1) / 2)::double as density from n, e",
)
add(
    "n_density_two_mode",
    lambda s, d: graph.two_mode_density(nodes_of(s, d), members_of(s, d)),
    f"with {_NODES}, {_MEMBERS}, d as ({_TWO_MODE}) select cast(sum(degree) as bigint) as edges, count(*) * (count(*) - 1) as potential, sum(degree) / (count(*) * (count(*) - 1))::double as density from d",
)

# neighbours of one node and of whole layers
#: Nodes that are asked about: one with many arcs out, one with many in, one with ties, two with memberships.
OUT, IN, TIED, JOINED, JOINED_TOO = 2, 1, 5, 37, 13
add("n_alters_out", lambda s, d: graph.alters(arcs_of(s, d), True, OUT, "out"), f"with {_ARCS} select dst as alter from arcs where src = {OUT}")
add("n_alters_in", lambda s, d: graph.alters(arcs_of(s, d), True, IN, "in"), f"with {_ARCS} select src as alter from arcs where dst = {IN}")
add("n_alters_both", lambda s, d: graph.alters(arcs_of(s, d), True, OUT, "both"), f"with {_ARCS} select dst as alter from arcs where src = {OUT} union select src from arcs where dst = {OUT}")
add("n_alters_undirected", lambda s, d: graph.alters(ties_of(s, d), False, TIED), f"with {_TIES} select dst as alter from both_ways where src = {TIED}")
add(
    "n_alters_two_mode",
    lambda s, d: graph.alters_two_mode(members_of(s, d), JOINED),
    f"with {_MEMBERS} select distinct y.node_id as alter from members x join members y on x.hyper_name = y.hyper_name where x.node_id = {JOINED} and y.node_id <> {JOINED}",
)
add(
    "n_neighbours_one_mode_layers",
    lambda s, d: graph.all_neighbours([("one", arcs_of(s, d), True), ("one", ties_of(s, d), False)]),
    f"with {_ARCS}, {_TIES} select src, dst from arcs union select src, dst from both_ways",
)
add(
    "n_shared_hyperedges",
    lambda s, d: graph.shared_hyperedges(members_of(s, d), JOINED, JOINED_TOO),
    f"with {_MEMBERS} select hyper_name from members where node_id = {JOINED} intersect select hyper_name from members where node_id = {JOINED_TOO}",
)
add("n_hyperedges_of_node", lambda s, d: members_of(s, d).where(F.col("node_id") == JOINED).select("hyper_name"), f"with {_MEMBERS} select hyper_name from members where node_id = {JOINED}")
add(
    "n_hyperedge_sizes",
    lambda s, d: members_of(s, d).groupBy("hyper_name").agg(F.count("*").alias("members")),
    f"with {_MEMBERS} select hyper_name, count(*) as members from members group by hyper_name",
)
add("n_edge_listing", lambda s, d: doubled(ties_of(s, d).where("src < dst")), f"with {_TIES} select src, dst, cast(value as double) as value from ties where src < dst")
add(
    "n_node_page",
    lambda s, d: nodes_of(s, d).select("node_id").orderBy("node_id").offset(500).limit(1000),
    f"with {_NODES} select node_id from nodes order by node_id limit 1000 offset 500",
)
add("n_node_by_index", lambda s, d: nodes_of(s, d).select("node_id").orderBy("node_id").offset(77).limit(1), f"with {_NODES} select node_id from nodes order by node_id limit 1 offset 77")
add(
    "n_node_ranks",
    lambda s, d: graph.numbered(nodes_of(s, d).select("node_id"), "node_id", "rank"),
    f"with {_NODES} select node_id, row_number() over (order by node_id) - 1 as rank from nodes",
)

# filters
for _name, _attr, _cond, _text, _where in (
    ("eq", "Office", "eq", "B", "Office = 'B'"),
    ("ne", "Office", "ne", "B", "Office is null or Office <> 'B'"),
    ("gt", "Age", "gt", "40", "Age > 40"),
    ("lt", "Age", "lt", "40", "Age < 40"),
    ("ge", "YearsWithFirm", "ge", "10", "YearsWithFirm >= 10"),
    ("le", "YearsWithFirm", "le", "10", "YearsWithFirm <= 10"),
    ("isnull", "Age", "isnull", None, "Age is null"),
    ("notnull", "Age", "notnull", None, "Age is not null"),
    ("ne_unreadable", "Age", "ne", "old", "Age is null"),
):
    add(
        f"n_filter_{_name}",
        lambda s, d, a=_attr, c=_cond, t=_text: nodes_of(s, d).where(attribute_condition(a, KINDS[a], c, t)).select("node_id", "Office", "Age", "YearsWithFirm"),
        f"with {_NODES} select node_id, Office, Age, YearsWithFirm from nodes where {_where}",
    )

# summaries
_BASE = "count({c}) as count, count(*) - count({c}) as missing, count({c}) * 100.0::double / count(*) as percentage"
_STATS = ", quantile_cont({c}, 0.5)::double as median, min({c})::double as min, max({c})::double as max, quantile_cont({c}, 0.25)::double as q1, quantile_cont({c}, 0.75)::double as q3"


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Mean and deviation without the digits that depend on the order of addition."""
    return df.withColumns({c: F.round(c, digits) for c in ("mean", "stddev")})


for _attr in ("Age", "YearsWithFirm"):
    add(
        f"n_summary_{_attr.lower()}",
        lambda s, d, a=_attr: rounded(graph.summary(nodes_of(s, d), a, "int"), 6),
        f"with {_NODES} select {_BASE.format(c=_attr)}, round(avg({_attr}), 6) as mean, round(stddev_pop({_attr}), 6) as stddev{_STATS.format(c=_attr)} from nodes",
    )
add(
    "n_summary_price",
    lambda s, d: rounded(graph.summary(parts_of(s, d), "price", "float"), 3),
    f"with p as (select cast(cast(p_retailprice as float) as double) as x from part), m as (select cast(cast(avg(x) as float) as double) as m from p) select {_BASE.format(c='x')}, round(any_value(m), 3) as mean, round(sqrt(avg((x - m) * (x - m))), 3) as stddev{_STATS.format(c='x')} from p, m",
)
add(
    "n_summary_deleted",
    lambda s, d: graph.summary(nodes_of(s, d), "Deleted", "bool"),
    f"with {_NODES} select {_BASE.format(c='Deleted')}, count(*) filter (Deleted) as count_true, count(*) filter (not Deleted) as count_false, count(*) filter (Deleted) * 100.0::double / count(Deleted) as ratio_true from nodes",
)
add(
    "n_summary_office",
    lambda s, d: graph.summary(nodes_of(s, d), "Office", "char"),
    f"with {_NODES} select Office as value, count(*) as count, min(node_id) as first_node from nodes where Office is not null group by Office",
)

# transforms
_FORMULAS = {
    "max": "greatest(v, r)", "min": "least(v, r)", "minnonzero": "case when v = 0 then r when r = 0 then v else least(v, r) end",
    "average": "(v + r) / cast(2 as float)", "sum": "v + r", "product": "v * r",
}
for _method, _formula in _FORMULAS.items():
    add(
        f"n_symmetrize_{_method}",
        lambda s, d, m=_method: doubled(graph.symmetrize(arcs_of(s, d), m, True)),
        f"""with {_ARCS}, p as (select least(src, dst) as src, greatest(src, dst) as dst, coalesce(max(value) filter (src <= dst), cast(0 as float)) as v, coalesce(max(value) filter (src >= dst), cast(0 as float)) as r from arcs group by 1, 2)
  select src, dst, cast(cast({_formula} as float) as double) as value from p where cast({_formula} as float) > 0""",
    )
add(
    "n_symmetrize_next",
    lambda s, d: doubled(graph.symmetrize(next_of(s, d), "sum", True)),
    f"with {_NEXT} select least(src, dst) as src, greatest(src, dst) as dst, cast(sum(value) as double) as value from nx group by 1, 2",
)
add(
    "n_dichotomize_ge",
    lambda s, d: doubled(graph.dichotomize(arcs_of(s, d), "ge", 20.0, 1.0, 0.0)[0]),
    f"with {_ARCS} select src, dst, 1.0::double as value from arcs where value >= 20",
)
add(
    "n_dichotomize_keep",
    lambda s, d: doubled(graph.dichotomize(arcs_of(s, d), "lt", 20.0, None, 5.0)[0]),
    f"with {_ARCS} select src, dst, case when value < 20 then cast(value as double) else 5.0 end as value from arcs",
)
_KEPT = "kept as (select node_id from nodes where Office = 'B')"
_B = lambda s, d: nodes_of(s, d).where("Office = 'B'")
add(
    "n_subnet_arcs",
    lambda s, d: doubled(graph.induced(arcs_of(s, d), _B(s, d))),
    f"with {_NODES}, {_KEPT}, {_ARCS} select src, dst, cast(value as double) as value from arcs where src in (select node_id from kept) and dst in (select node_id from kept)",
)
add(
    "n_subnet_members",
    lambda s, d: graph.induced_members(members_of(s, d), _B(s, d)),
    f"with {_NODES}, {_KEPT}, {_MEMBERS} select hyper_name, node_id from members where node_id in (select node_id from kept)",
)


def chain(spark: SparkSession, d: str) -> DataFrame:
    """Degree, filter by it, sub-network, density: the reference chain of attribute and layer operators."""
    nodes, arcs = nodes_of(spark, d), arcs_of(spark, d)
    active = graph.degree(nodes, arcs, True, "in").where("degree >= 2")
    return graph.density(active, graph.induced(arcs, active), True, True)


add(
    "n_chain",
    chain,
    f"""with {_NODES}, {_ARCS}, active as (select n.node_id from nodes n join arcs a on n.node_id = a.dst group by n.node_id having count(*) >= 2),
  n as (select count(*) as n from active), e as (select count(*) as edges from arcs where src in (select node_id from active) and dst in (select node_id from active))
  select edges, n * n as potential, edges / (n * n)::double as density from n, e""",
)

# components and paths
_CC = """cc(v, comp) using key (v) as (select v, v from verts union
  select u.v, min(w.comp) from recurring.cc u join links on u.v = links.a join cc w on links.b = w.v where w.comp < u.comp group by u.v)"""
add(
    "n_components_arcs",
    lambda s, d: graph.components(nodes_of(s, d), arcs_of(s, d).select("src", "dst")),
    f"""with recursive {_NODES}, {_ARCS}, links as (select src as a, dst as b from arcs union select dst, src from arcs), verts as (select node_id as v from nodes union select a from links), {_CC},
  own as (select node_id, comp from nodes join cc on node_id = v), firsts as (select comp, min(node_id) as f from own group by comp), nr as (select comp, row_number() over (order by f) - 1 as k from firsts)
  select node_id, cast(k as integer) as component from own join nr on own.comp = nr.comp""",
)
add(
    "n_components_two_mode",
    lambda s, d: graph.components(nodes_of(s, d), graph.bipartite(members_of(s, d))),
    f"""with recursive {_NODES}, {_MEMBERS}, h as (select hyper_name, 1000000000000 + row_number() over (order by hyper_name) as k from (select distinct hyper_name from members)),
  links as (select node_id as a, k as b from members join h on members.hyper_name = h.hyper_name union select k, node_id from members join h on members.hyper_name = h.hyper_name),
  verts as (select node_id as v from nodes union select a from links), {_CC},
  own as (select node_id, comp from nodes join cc on node_id = v), firsts as (select comp, min(node_id) as f from own group by comp), nr as (select comp, row_number() over (order by f) - 1 as k from firsts)
  select node_id, cast(k as integer) as component from own join nr on own.comp = nr.comp""",
)


def _from(spark: SparkSession, node: int) -> DataFrame:
    return spark.createDataFrame([(node,)], "node_id long")


_BFS = """bfs(node_id, distance) using key (node_id) as (select {ego}::bigint, 0 union
  select l.b, min(x.distance) + 1 from bfs x join links l on x.node_id = l.a left join recurring.bfs k on k.node_id = l.b where k.node_id is null group by l.b)"""
#: Hyperedges as vertices of their own, from 10^12 on, so that a membership step is two links.
_THROUGH = """h as (select hyper_name, 1000000000000 + row_number() over (order by hyper_name) as k from (select distinct hyper_name from members)),
  halves as (select node_id as a, k as b from members join h on members.hyper_name = h.hyper_name union all select k, node_id from members join h on members.hyper_name = h.hyper_name)"""
_HALVED = "select node_id, cast(distance // 2 as integer) as distance from bfs where node_id < 1000000000000"
add(
    "n_distances_arcs",
    lambda s, d: graph.distances(_from(s, OUT), [graph.step_one_mode(arcs_of(s, d), True)])[0],
    f"with recursive {_ARCS}, links as (select src as a, dst as b from arcs), {_BFS.format(ego=OUT)} select node_id, distance from bfs",
)
add(
    "n_distances_all_layers",
    lambda s, d: graph.distances(_from(s, OUT), [graph.step_one_mode(arcs_of(s, d), True), graph.step_one_mode(ties_of(s, d), False), graph.step_two_mode(members_of(s, d))])[0],
    f"""with recursive {_ARCS}, {_TIES}, {_MEMBERS}, {_THROUGH}, one_mode as (select src, dst from arcs union select src, dst from both_ways),
  mids as (select src, dst, 2000000000000 + row_number() over (order by src, dst) as k from one_mode),
  links as (select a, b from halves union all select src, k from mids union all select k, dst from mids), {_BFS.format(ego=OUT)} {_HALVED}""",
)
add(
    "n_distances_two_mode",
    lambda s, d: graph.distances(_from(s, JOINED), [graph.step_two_mode(members_of(s, d))])[0],
    f"with recursive {_MEMBERS}, {_THROUGH}, links as (select a, b from halves), {_BFS.format(ego=JOINED)} {_HALVED}",
)

# sampling and generators: seeded draws of our own, so what is compared is whether they are draws of the kind asked for
def _within(value, mean, deviation) -> Column:
    """Five standard deviations about what is expected."""
    return F.abs(value - mean) <= 5 * deviation


def _beside(*frames: DataFrame) -> DataFrame:
    """One row with the columns of frames of one row each."""
    values = [v for f in frames for v in f.first()]
    return frames[0].sparkSession.createDataFrame([tuple(values)], StructType([field for f in frames for field in f.schema.fields]))


def _one_of(picked: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    return picked.join(of.distinct(), keys, "left_semi").agg(F.count("*").alias("n"))


add("n_random_node", lambda s, d: _one_of(nodes_of(s, d).select("node_id").orderBy(uniform(DEFAULT_SEED, "node", F.col("node_id"))).limit(1), nodes_of(s, d), ["node_id"]), "select 1::bigint as n")
add("n_random_alter", lambda s, d: _one_of((x := graph.alters(arcs_of(s, d), True, OUT, "both")).orderBy(uniform(DEFAULT_SEED, "alter", F.col("alter"))).limit(1), x, ["alter"]), "select 1::bigint as n")
add("n_random_edge", lambda s, d: _one_of((x := doubled(arcs_of(s, d))).orderBy(uniform(DEFAULT_SEED, "edge", F.col("src"), F.col("dst"))).limit(1), x, ["src", "dst", "value"]), "select 1::bigint as n")


def attributes(spark: SparkSession, d: str) -> DataFrame:
    out = nodes_of(spark, d).select("node_id", *[generators.random_attribute(k, DEFAULT_SEED, k).alias(k) for k in ("int", "float", "bool", "char")])
    n = F.count("*")
    return out.agg(
        n.alias("nodes"), F.bool_and(F.col("int").between(0, 100)).alias("int_range"), _within(F.avg("int"), 50, F.sqrt(F.lit((101**2 - 1) / 12) / n)).alias("int_mean"),
        F.bool_and((F.col("float") >= 0) & (F.col("float") <= 1)).alias("float_range"), _within(F.avg("float"), 0.5, F.sqrt(F.lit(1 / 12) / n)).alias("float_mean"),
        _within(F.avg(F.col("bool").cast("int")), 0.5, F.sqrt(F.lit(0.25) / n)).alias("bool_rate"), F.bool_and(F.col("char").isin("m", "f", "o")).alias("char_set"),
        _within(F.avg((F.col("char") == "m").cast("int")), 1 / 3, F.sqrt(F.lit(2 / 9) / n)).alias("char_rate"),
    )


add("n_generate_attributes", attributes, f"with {_NODES} select count(*) as nodes, true as int_range, true as int_mean, true as float_range, true as float_mean, true as bool_rate, true as char_set, true as char_rate from nodes")


def _shape(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges, repeated pairs, self-ties, strangers."""
    ids = nodes.select("node_id")
    strange = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).join(ids, "node_id", "left_anti").agg(F.count("*").alias("strangers"))
    own = edges.agg(F.count("*").alias("edges"), (F.count("*") - F.count_distinct("src", "dst")).alias("repeated"), F.count_if(F.col("src") == F.col("dst")).alias("selfties"))
    return _beside(own, strange, nodes.agg(F.count("*").alias("nodes")))


_RUNS = "src long, low long, high long, n long, repeated long, selfties long, block long, bits binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges in short: for each start in a batch the least and greatest end, the edges, those that are there before and self-ties.  Ends as bitmaps of blocks of ids."""
    seen: dict[int, np.ndarray] = {}
    pending: list[np.ndarray] = []
    fields = [pa.int64()] * 7 + [pa.binary()]
    names = [x.split()[0] for x in _RUNS.split(", ")]

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(next(x for x in columns if x is not None)), f) if c is None else pa.array(c, f) for c, f in zip(columns, fields)], names=names)

    def marked() -> None:
        ends = np.concatenate(pending)
        pending.clear()
        first = int(ends.min()) >> 15 << 15
        if int(ends.max()) - first < 1 << 24:
            hit = np.zeros(((int(ends.max()) - first >> 15) + 1) << 15, bool)
            hit[ends - first] = True
            for k, part in enumerate(hit.reshape(-1, 1 << 15)):
                if part.any():
                    seen[(first >> 15) + k] = part | seen.get((first >> 15) + k, False)
        else:
            ends = np.unique(ends)
            blocks, starts = np.unique(ends >> 15, return_index=True)
            for block, own in zip(blocks.tolist(), np.split(ends & 32767, starts[1:])):
                seen.setdefault(block, np.zeros(1 << 15, bool))[own] = True
                if len(seen) >= 1000:
                    full.append(told())
        if len(seen) >= 1000:
            full.append(told())

    def told() -> pa.RecordBatch:
        blocks = sorted(seen)
        batch = rows(*[None] * 6, blocks, [np.packbits(seen[k], bitorder="little").tobytes() for k in blocks])
        seen.clear()
        return batch

    full: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        src, dst = b.column(0).to_numpy(), b.column(1).to_numpy()
        pending.append(dst)
        if not ((src[1:] > src[:-1]) | (src[1:] == src[:-1]) & (dst[1:] >= dst[:-1])).all():
            order = np.lexsort((dst, src))
            src, dst = src[order], dst[order]
        new = np.append(True, src[1:] != src[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(src)) - 1
        again = ~new & np.append(False, dst[1:] == dst[:-1])
        yield rows(src[starts], dst[starts], dst[ends], ends - starts + 1, np.add.reduceat(again.astype(np.int64), starts), np.add.reduceat((src == dst).astype(np.int64), starts), None, None)
        if sum(map(len, pending)) >= 1_000_000:
            marked()
        yield from full
        full.clear()
    if pending:
        marked()
    yield from full
    if seen:
        yield told()


def _shape_in_short(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`_shape` and the variance of out-degrees (`spread`) in one pass, for edges too many to move that come start by start, ordered by their ends.

    Only edges of starts whose stretches of ends meet are compared one by one, and ends are only counted if some are no nodes.
    """
    short = written(edges.select("src", "dst").mapInArrow(_runs, _RUNS))
    runs = short.where("src is not null")
    before = F.max("high").over(W.partitionBy("src").orderBy("low", "high").rowsBetween(W.unboundedPreceding, -1))
    starts = runs.withColumn("meets", F.coalesce(before >= F.col("low"), F.lit(False))).groupBy("src")
    starts = cut(starts.agg(F.sum("n").alias("n"), F.sum("repeated").alias("repeated"), F.sum("selfties").alias("selfties"), F.max("meets").alias("meets")))
    own = starts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.when(~F.col("meets"), F.col("repeated"))), F.lit(0)).alias("repeated"),
        F.coalesce(F.sum("selfties"), F.lit(0)).alias("selfties"), F.count_if("meets").alias("meeting"),
    )
    if own.first()["meeting"]:
        more = edges.join(starts.where("meets").select("src"), "src", "left_semi").agg((F.count("*") - F.count_distinct("src", "dst")).alias("more"))
        own = own.crossJoin(more).withColumn("repeated", F.col("repeated") + F.col("more"))
    bits = lambda df, c: df.groupBy(F.shiftright(c, 15).alias("block")).agg(F.bitmap_construct_agg(F.col(c).bitwiseAND(F.lit(32767))).alias("bits"))
    ids = nodes.select("node_id")
    there = bits(ids, "node_id")
    count = lambda df: df.groupBy("block").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if count(there.unionByName(bits(starts, "src")).unionByName(short.where("block is not null").select("block", "bits"))) == count(there):
        strange = edges.sparkSession.range(1).select(F.lit(0).cast("long").alias("strangers"))
    else:
        strange = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).join(ids, "node_id", "left_anti").agg(F.count("*").alias("strangers"))
    degrees = ids.join(starts.select(F.col("src").alias("node_id"), "n"), "node_id", "left")
    even = degrees.agg(F.count("*").alias("nodes"), F.var_pop(F.coalesce("n", F.lit(0))).alias("spread"))
    return _beside(own.select("edges", "repeated", "selfties"), strange, even)


def erdos_renyi_shape(spark: SparkSession, d: str) -> DataFrame:
    nodes, p = nodes_of(spark, d), 0.0005
    edges = generators.erdos_renyi(nodes, p, True, False, DEFAULT_SEED)
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    row = _shape_in_short(edges, nodes).withColumn("expected", (F.col("nodes") - 1) * p * (1 - p))
    # the variance of a binomial sample of n degrees has a deviation of about sqrt(2 / n + 1 / (n * mean)) of itself
    spread = _within(F.col("spread"), F.col("expected"), F.col("expected") * F.sqrt(2 / F.col("nodes") + 1 / (F.col("nodes") * F.col("expected"))))
    return row.select("nodes", "repeated", "selfties", "strangers", _within(F.col("edges"), pairs * p, F.sqrt(pairs * p * (1 - p))).alias("density"), spread.alias("spread"))


add("n_generate_er", erdos_renyi_shape, f"with {_NODES} select count(*) as nodes, 0::bigint as repeated, 0::bigint as selfties, 0::bigint as strangers, true as density, true as spread from nodes")


def watts_strogatz_shape(spark: SparkSession, d: str) -> DataFrame:
    nodes, k, beta = nodes_of(spark, d), 6, 0.05
    edges = generators.watts_strogatz(nodes, k, beta, DEFAULT_SEED)
    ranked = graph.numbered(nodes.select("node_id"), "node_id", "rank")
    a, b = (ranked.select(F.col("node_id").alias(x), F.col("rank").alias(f"r{x}")) for x in ("src", "dst"))
    apart = F.abs(F.col("rsrc") - F.col("rdst"))
    near = edges.join(a, "src").join(b, "dst").agg(F.count_if(F.least(apart, F.lit(nodes.count()) - apart) <= k // 2).alias("kept"))
    row = _beside(_shape(edges, nodes), near)
    # a moved edge falls on the lattice again by chance k / n of the time
    kept = _within(F.col("kept"), F.col("edges") * (1 - beta + beta * k / F.col("nodes")), F.sqrt(F.col("edges") * beta * (1 - beta)))
    return row.select("nodes", "edges", "repeated", "selfties", "strangers", kept.alias("rewired"))


add("n_generate_ws", watts_strogatz_shape, f"with {_NODES} select count(*) as nodes, count(*) * 3 as edges, 0::bigint as repeated, 0::bigint as selfties, 0::bigint as strangers, true as rewired from nodes")


def barabasi_albert_shape(spark: SparkSession, d: str) -> DataFrame:
    """The share of nodes with the least degree m is 2 / (m + 2) in the limit, and the tail falls as the square of the degree."""
    nodes, m = nodes_of(spark, d), 3
    edges = generators.barabasi_albert(nodes, m, DEFAULT_SEED)
    degrees = graph.degree(nodes, edges, False)
    tail = degrees.agg(F.min("degree").alias("least"), F.avg((F.col("degree") == m).cast("int")).alias("lowest"), F.avg((F.col("degree") >= 20).cast("int")).alias("high"))
    row = _beside(_shape(edges, nodes), tail)
    limit = m * (m + 1) / (20 * 21)
    return row.select(
        "nodes", "edges", "repeated", "selfties", "strangers", (F.col("least") >= m).alias("least"), (F.abs(F.col("lowest") - 2 / (m + 2)) < 0.05).alias("lowest"), F.col("high").between(limit / 2, limit * 2).alias("tail")
    )


add(
    "n_generate_ba", barabasi_albert_shape,
    f"with {_NODES} select count(*) as nodes, 6 + 3 * (count(*) - 4) as edges, 0::bigint as repeated, 0::bigint as selfties, 0::bigint as strangers, true as least, true as lowest, true as tail from nodes",
)


def two_mode_shape(spark: SparkSession, d: str) -> DataFrame:
    nodes, h, mean = nodes_of(spark, d), 200, 5
    members = generators.random_two_mode(nodes, h, mean, DEFAULT_SEED)
    each = nodes.select("node_id").join(members.groupBy("node_id").agg(F.count("*").alias("k")), "node_id", "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    row = each.agg(F.count("*").alias("nodes"), F.avg("k").alias("mean"), F.var_pop("k").alias("spread"))
    row = _beside(row, members.agg(F.count_distinct("hyper_name").alias("names"), (F.count("*") - F.count_distinct("hyper_name", "node_id")).alias("repeated")))
    n = F.col("nodes")
    return row.select("nodes", "repeated", (F.col("names") <= h).alias("names"), _within(F.col("mean"), mean, F.sqrt(mean / n)).alias("mean"), _within(F.col("spread"), mean, mean * F.sqrt(2 / n + 1 / (n * mean))).alias("spread"))


add("n_generate_two_mode", two_mode_shape, f"with {_NODES} select count(*) as nodes, 0::bigint as repeated, true as names, true as mean, true as spread from nodes")


# files, in the shared folder
def _network(spark: SparkSession, d: str) -> Network:
    net = Network(spark, "net", Nodeset(spark, "nodes", nodes_of(spark, d).drop("Deleted"), KINDS))
    net.add_one_mode("trade", True, True, True, arcs_of(spark, d))
    net.add_two_mode("groups", members_of(spark, d))
    return net


def parquet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    net, root = _network(spark, d), f"{checkpoint_folder(spark)}/netloom-{uuid.uuid4().hex}"
    net.nodeset.path = f"{root}/nodes.parquet"
    files.write_parquet(net.nodeset, net.nodeset.path)
    files.write_parquet(net, f"{root}/net.parquet")
    return doubled(spark.read.parquet(f"{root}/net.parquet/layer_0"))


def edge_list_round_trip(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/netloom-{uuid.uuid4().hex}"
    edgelists.layer_rows(_network(spark, d), "trade").write.mode("overwrite").option("sep", ";").csv(folder)
    lines = spark.read.text(folder).select(F.col("value").alias("line"))
    cells = F.split("line", ";")
    return lines.select(files.node_id(cells[0]).alias("src"), files.node_id(cells[1]).alias("dst"), cells[2].cast("float").cast("double").alias("value"))


_TRADE = f"with {_ARCS} select src, dst, cast(value as double) as value from arcs"
add("n_parquet_round_trip", parquet_round_trip, _TRADE)
add("n_edge_list_round_trip", edge_list_round_trip, _TRADE)
