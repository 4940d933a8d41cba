"""Layers as DataFrames, and everything that is asked of them.

A 1-mode layer is `edges(src, dst, value)`: a directed one has a row per arc, an undirected one a row per edge with
src <= dst.  A 2-mode layer is `members(hyper_name, node_id)`, without repetitions.  All functions are lazy unless they say
otherwise; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.conditions import compare
from netloom.functions.tables import cut, written

#: Hyperedges beyond this size are never enumerated pair by pair.
LARGE = 128


def arcs(edges: DataFrame, directed: bool) -> DataFrame:
    """Both directions of an undirected layer (a self-tie once), the arcs of a directed one."""
    if directed:
        return edges.select("src", "dst", "value")
    back = edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value")
    return edges.select("src", "dst", "value").unionByName(back)


def canonical(edges: DataFrame, directed: bool) -> DataFrame:
    """Edges with src <= dst if undirected."""
    if directed:
        return edges
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "value")


# --- neighbours -------------------------------------------------------------------------------------------------


def alters(edges: DataFrame, directed: bool, ego: int, direction: str = "both") -> DataFrame:
    """(alter) of one node.  Directed: `both` is the distinct union; undirected: direction is ignored."""
    if not directed:
        ends = F.when(F.col("src") == ego, F.col("dst")).otherwise(F.col("src"))
        return edges.where((F.col("src") == ego) | (F.col("dst") == ego)).select(ends.alias("alter"))
    out = edges.where(F.col("src") == ego).select(F.col("dst").alias("alter"))
    into = edges.where(F.col("dst") == ego).select(F.col("src").alias("alter"))
    return {"out": out, "in": into}.get(direction, None) if direction != "both" else out.union(into).distinct()


def alters_two_mode(members: DataFrame, ego: int) -> DataFrame:
    """(alter): distinct members of all hyperedges of the ego, but for itself."""
    mine = members.where(F.col("node_id") == ego).select("hyper_name")
    near = members.join(mine, "hyper_name", "left_semi").where(F.col("node_id") != ego)
    return near.select(F.col("node_id").alias("alter")).distinct()


def shared_hyperedges(members: DataFrame, a: int, b: int) -> DataFrame:
    """(hyper_name) that two nodes share; with a = b those of the node."""
    return members.where(F.col("node_id").isin(a, b)).groupBy("hyper_name").agg(F.countDistinct("node_id").alias("n")).where(F.col("n") == (1 if a == b else 2)).select("hyper_name")


def all_neighbours(layers: list[tuple[str, DataFrame, bool]]) -> DataFrame:
    """Distinct (src, dst) over 1-mode layers given as (kind, edges, directed); kind `one`."""
    out = None
    for _, edges, directed in layers:
        part = arcs(edges, directed).select("src", "dst")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


# --- degree and density -------------------------------------------------------------------------------------------


def degree(nodes: DataFrame, edges: DataFrame, directed: bool, direction: str = "in") -> DataFrame:
    """(node_id, degree) of every node, 0 for isolates; gross (`both`) degree counts in and out."""
    if directed and direction != "both":
        ends = edges.select(F.col("dst" if direction == "in" else "src").alias("node_id"))
    else:
        pair = F.array("src", "dst") if directed else F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
        ends = edges.select(F.explode(pair).alias("node_id"))
    counts = ends.groupBy("node_id").agg(F.count("*").cast("int").alias("degree"))
    return nodes.select("node_id").join(counts, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def two_mode_degree(nodes: DataFrame, members: DataFrame, large: int = LARGE) -> DataFrame:
    """(node_id, degree): number of distinct alters over all hyperedges, without projecting the layer.

    Small hyperedges are enumerated.  A large one is a set of bitmaps, one for each range of ids; nodes with the same set of
    large hyperedges form a class (named by its least node), whose reach is the count of bits of the united bitmaps.  Alters met in a small
    hyperedge count if their classes share no large hyperedge.  Sets are never gathered: a class is known by its size and two sums.
    """
    members = members.select("hyper_name", "node_id")
    sizes = members.groupBy("hyper_name").agg(F.count("*").alias("size"))
    members = members.join(sizes, "hyper_name")
    big = members.where(F.col("size") > large).select("hyper_name", "node_id")
    prints = [F.count("*").alias("k"), F.bit_xor(F.xxhash64("hyper_name")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(11), "hyper_name"), 20)).alias("y")]
    classed = big.groupBy("node_id").agg(*prints).select("node_id", F.struct("k", "x", "y").alias("class"))
    model = classed.groupBy("class").agg(F.min("node_id").alias("one"))  # one node stands for its class, and is its name
    classed = classed.join(model, "class").select("node_id", F.col("one").alias("class"))
    held = written(big.join(model.select(F.col("one").alias("node_id")), "node_id").select(F.col("node_id").alias("class"), "hyper_name"))
    bits = big.groupBy("hyper_name", F.bitmap_bucket_number("node_id").alias("range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("node_id")).alias("bits"))
    united = held.join(bits, "hyper_name").groupBy("class", "range").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    reach = united.groupBy("class").agg((F.sum("n") - 1).alias("far"))
    far = classed.join(reach, "class").select("node_id", "far")

    small = members.where(F.col("size") <= large).select("hyper_name", "node_id").join(classed, "node_id", "left")
    a = small.select("hyper_name", F.col("node_id").alias("u"), F.col("class").alias("cu"))
    b = small.select("hyper_name", F.col("node_id").alias("v"), F.col("class").alias("cv"))
    met = written(a.join(b, "hyper_name").where(F.col("u") < F.col("v")).groupBy("u", "v").agg(F.first("cu").alias("cu"), F.first("cv").alias("cv")))
    # pairs of classes that met: those that share a large hyperedge are counted by it already
    asked = met.where("cu is not null and cv is not null").select("cu", "cv").distinct()
    other = held.select(F.col("class").alias("cv"), "hyper_name")
    shared = asked.join(held.withColumnRenamed("class", "cu"), "cu").join(other, ["cv", "hyper_name"], "left_semi").select("cu", "cv").distinct()
    near = met.join(shared, ["cu", "cv"], "left_anti").select(F.explode(F.array("u", "v")).alias("node_id"))
    near = near.groupBy("node_id").agg(F.count("*").alias("near"))
    out = nodes.select("node_id").join(far, "node_id", "left").join(near, "node_id", "left")
    return out.select("node_id", (F.coalesce("far", F.lit(0)) + F.coalesce("near", F.lit(0))).cast("int").alias("degree"))


def density(nodes: DataFrame, edges: DataFrame, directed: bool, selfties: bool) -> DataFrame:
    """(edges, potential, density); NaN where nothing is possible."""
    none = F.lit(0).cast("long")
    both = nodes.agg(F.count("*").alias("n"), none.alias("edges")).unionByName(edges.agg(none.alias("n"), F.count("*").alias("edges")))
    row = both.agg(F.sum("n").alias("n"), F.sum("edges").alias("edges"))
    pairs = F.col("n") * (F.col("n") if selfties else F.col("n") - 1) if directed else F.col("n") * (F.col("n") + (1 if selfties else -1)) / 2
    row = row.select("edges", F.when(F.col("n") < 2, 0).otherwise(pairs).cast("long").alias("potential"))
    return row.withColumn("density", F.when(F.col("potential") > 0, F.col("edges") / F.col("potential")).otherwise(F.lit(float("nan"))))


def two_mode_density(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(edges, potential, density): ordered pairs of nodes that share a hyperedge, of n(n-1)."""
    row = two_mode_degree(nodes, members).agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("edges"), F.count("*").alias("n"))
    row = row.select("edges", (F.col("n") * (F.col("n") - 1)).alias("potential"))
    return row.withColumn("density", F.when(F.col("potential") > 0, F.col("edges") / F.col("potential")).otherwise(F.lit(float("nan"))))


# --- components and paths ----------------------------------------------------------------------------------------


def bipartite(members: DataFrame) -> DataFrame:
    """(src, dst): memberships as edges between node ids and numbers above 2^33 for hyperedges.  Eager (one checkpoint)."""
    names = cut(members.select("hyper_name").distinct().withColumn("h", F.monotonically_increasing_id() + F.lit(2**33)))
    return members.join(names, "hyper_name").select(F.col("node_id").alias("src"), F.col("h").alias("dst"))


def min_labels(pairs: DataFrame) -> DataFrame:
    """(vertex, label): smallest vertex of each vertex's connected component, for all vertices in (src, dst).  Eager.

    Alternating large-star and small-star steps, which take O(log^2 n) rounds on any graph; every step is an aggregation
    with partial sums and an equi-join, and lineage is cut after each round.  The rounds end when nothing changes.
    """
    loops = pairs.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    now = cut(pairs.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    seen = None
    while True:
        # large star: larger neighbours of u are tied to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u, and u, are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first()
        if mark == seen:
            break
        seen = mark
    labels = now.groupBy("u").agg(F.min("v").alias("label"))
    return loops.join(labels, F.col("v") == F.col("u"), "left").select(F.col("v").alias("vertex"), F.coalesce("label", "v").alias("label"))


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id, component): weak components numbered from 0 by their smallest node; isolates are components.  Eager.

    Vertices that are no nodes (hyperedges, strangers) connect, but get no row.
    """
    labels = min_labels(pairs)
    own = nodes.select("node_id").distinct().join(labels, F.col("node_id") == F.col("vertex"), "left")
    own = own.select("node_id", F.coalesce("label", "node_id").alias("label"))
    # a component is named by its smallest node; numbering is a rank over component names, ranged rather than windowed
    first = own.groupBy("label").agg(F.min("node_id").alias("first"))
    first = numbered(first, "first", "component")
    return own.join(first, "label").select("node_id", F.col("component").cast("int").alias("component"))


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """Numbers rows from 0 in the order of a unique column: ranges are sorted apart, and offset by the rows before them."""
    from pyspark.sql.window import Window as W

    parts = cut(df.repartitionByRange(by).withColumn("part_", F.spark_partition_id()))
    sizes = sorted((r["part_"], r["count"]) for r in parts.groupBy("part_").count().collect())  # a row per partition
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(offsets, "part_ int, before_ long")
    rank = F.row_number().over(W.partitionBy("part_").orderBy(by)) - 1
    return parts.join(F.broadcast(offsets), "part_").withColumn(name, F.col("before_") + rank).drop("part_", "before_")


def distances(sources: DataFrame, steps, limit: int | None = None, target: int | None = None) -> tuple[DataFrame, int]:
    """((node_id, distance) of all nodes reached, distance of `target` or -1), breadth first.  Eager.

    steps: functions from frontier (node_id) to the nodes one step on; their union is taken.  Lineage is cut each round.
    """
    seen = cut(sources.select("node_id", F.lit(0).alias("distance")).distinct())
    frontier, level = seen, 0
    if target is not None and not seen.where(F.col("node_id") == target).isEmpty():
        return seen, 0
    while limit is None or level < limit:
        level += 1
        near = None
        for step in steps:
            part = step(frontier.select("node_id"))
            near = part if near is None else near.unionByName(part)
        frontier = cut(near.distinct().join(seen, "node_id", "left_anti").withColumn("distance", F.lit(level)))
        if target is not None and not frontier.where(F.col("node_id") == target).isEmpty():
            return seen.unionByName(frontier), level
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen, -1


def step_one_mode(edges: DataFrame, directed: bool):
    links = arcs(edges, directed).select("src", F.col("dst").alias("next_"))
    return lambda frontier: frontier.join(links, frontier["node_id"] == links["src"]).select(F.col("next_").alias("node_id"))


def step_two_mode(members: DataFrame):
    """Node to hyperedge to node, never the projection."""

    def step(frontier: DataFrame) -> DataFrame:
        reached = members.join(frontier, "node_id", "left_semi").select("hyper_name").distinct()
        return members.join(reached, "hyper_name", "left_semi").select("node_id")

    return step


# --- summaries ---------------------------------------------------------------------------------------------------


def summary(nodes: DataFrame, name: str, kind: str) -> DataFrame:
    """One row with the statistics of an attribute; char: a row per value with its count, most frequent first (ties: lowest node)."""
    c = F.col(f"`{name}`")
    if kind == "char":
        groups = nodes.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count("*").alias("count"), F.min("node_id").alias("first_node"))
        return groups
    base = [F.count(c).alias("count"), F.count_if(c.isNull()).alias("missing"), (F.count(c) * 100.0 / F.count("*")).alias("percentage")]
    if kind == "bool":
        true = F.count_if(c)
        ratio = F.when(F.count(c) > 0, true * 100.0 / F.count(c)).otherwise(0.0)
        return nodes.agg(*base, true.alias("count_true"), F.count_if(~c).alias("count_false"), ratio.alias("ratio_true"))
    x = c.cast("double")
    mean, spread = F.avg(x), F.stddev_pop(x)
    if kind == "float":  # the mean is rounded to the attribute's own precision, and deviations are taken from that
        near = mean.cast("float").cast("double")
        mean, spread = near, F.sqrt(F.var_pop(x) + (F.avg(x) - near) * (F.avg(x) - near))
    return nodes.agg(
        *base, mean.alias("mean"), F.percentile(x, 0.5).alias("median"), spread.alias("stddev"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.percentile(x, 0.25).alias("q1"), F.percentile(x, 0.75).alias("q3"),
    )


# --- transforms --------------------------------------------------------------------------------------------------

SYMMETRIZERS = ("max", "min", "minnonzero", "average", "sum", "product")


def symmetrize(edges: DataFrame, method: str, valued: bool) -> DataFrame:
    """Undirected edges from arcs: f(value, value of the reverse arc or 0), kept where above 0; binary layers get 1."""
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.max(F.when(F.col("src") <= F.col("dst"), F.col("value"))).alias("up"), F.max(F.when(F.col("src") >= F.col("dst"), F.col("value"))).alias("down")
    )
    v, r = F.coalesce("up", F.lit(0.0).cast("float")), F.coalesce("down", F.lit(0.0).cast("float"))
    combined: Column = {
        "max": F.greatest(v, r),
        "min": F.least(v, r),
        "minnonzero": F.when(v == 0, r).when(r == 0, v).otherwise(F.least(v, r)),
        "average": (v + r) / F.lit(2.0).cast("float"),
        "sum": v + r,
        "product": v * r,
    }[method]
    out = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), combined.cast("float").alias("value")).where("value > 0")
    return out if valued else out.withColumn("value", F.lit(1.0).cast("float"))


def dichotomize(edges: DataFrame, cond: str, threshold: float, true_value: float | None, false_value: float | None) -> tuple[DataFrame, bool]:
    """(edges, valued): each value replaced by the condition; None keeps it.  A false value of 0 drops the edge, a true value of 0 keeps it."""
    holds = compare(F.col("value"), cond, float(threshold), floating=True)
    pick = lambda x: F.col("value") if x is None else F.lit(float(x)).cast("float")
    out = edges.withColumn("holds", holds).withColumn("value", F.when(F.col("holds"), pick(true_value)).otherwise(pick(false_value)))
    out = out.where("holds or value <> 0").select("src", "dst", "value")
    unit = lambda x: x is not None and min(abs(x), abs(x - 1)) < 1e-6
    return out, not (unit(true_value) and unit(false_value))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select(F.col("node_id").alias("src"))
    return edges.join(ids, "src", "left_semi").join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst", "value")


def induced_members(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Memberships of the nodes; hyperedges left without any are gone."""
    return members.join(nodes.select("node_id"), "node_id", "left_semi").select("hyper_name", "node_id")
