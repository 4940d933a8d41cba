"""Random attributes and layers.  Every draw is seeded by (seed, row), so results do not depend on partitioning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.chance import draw, generator, uniform
from netloom.functions.errors import Failure
from netloom.functions.tables import cut, shuffle_width
from netloom.operators.graph import numbered

EDGES = "src long, dst long, value float"


def random_attribute(kind: str, seed: int, stream: str, low=None, high=None, p: float = 0.5, chars: str = "m;f;o") -> Column:
    """int: uniform on [low, high]; float: uniform on [low, high); bool: true with probability p; char: one of the list."""
    u = uniform(seed, stream, F.col("node_id"))
    if kind == "int":
        low, high = 0 if low is None else int(low), 100 if high is None else int(high)
        if low > high:
            raise Failure("InvalidArgument", "The lower bound is above the upper.")
        return (F.floor(u * (high - low + 1)) + low).cast("int")
    if kind == "float":
        low, high = 0.0 if low is None else float(low), 1.0 if high is None else float(high)
        return (u * (high - low) + low).cast("float")
    if kind == "bool":
        if not 0 <= p <= 1:
            raise Failure("InvalidArgument", "A probability lies between 0 and 1.")
        return u < p
    letters = [c.strip() for c in chars.split(";")]
    if not letters or any(len(c) != 1 for c in letters):
        raise Failure("InvalidArgument", "Characters are given one by one, divided by semicolons.")
    return F.element_at(F.array(*[F.lit(c) for c in letters]), (F.floor(u * len(letters)) + 1).cast("int"))


def _ranked(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(rank, node_id) in ascending order, and the number of nodes."""
    ranked = cut(numbered(nodes.select("node_id").distinct(), "node_id", "rank"))
    return ranked, ranked.count()


def _named(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Ranks of both ends to node ids."""
    a = ranked.select(F.col("rank").alias("a"), F.col("node_id").alias("src"))
    b = ranked.select(F.col("rank").alias("b"), F.col("node_id").alias("dst"))
    return pairs.join(a, "a").join(b, "b").select("src", "dst", F.lit(1.0).cast("float").alias("value"))


#: Columns in a tile of the pair table, whose ids (8 bytes each) a task holds.
TILE = 1 << 20
#: Sparser layers are named by joins, as the ids of a tile would outweigh its edges.
SPARSE = 1e-6


def _strips(ranked: DataFrame, size: int) -> DataFrame:
    """(at, ids): the first rank of each strip of that many ranks, and its ids in their order, as bytes.  Each is a partition of its own."""

    def gathered(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        return pa.table({"at": pa.array([t["rank"][0].as_py()], pa.int64()), "ids": pa.array([t["node_id"].to_numpy().tobytes()], pa.binary())})

    strips = cut(ranked.select("rank", F.col("node_id").cast("long")).groupBy(F.expr(f"rank div {size}")).applyInArrow(gathered, "at long, ids binary"))
    return cut(strips.repartitionByRange(max(1, strips.count()), "at"))


def erdos_renyi(nodes: DataFrame, p: float, directed: bool, selfties: bool, seed: int) -> DataFrame:
    """Every possible pair with probability p, by geometric jumps along each row of the pair table (Batagelj and Brandes 2005).

    A task draws a tile of the table and has the ids of its rows and columns, so no edge is moved to be named.
    """
    if not 0 <= p <= 1:
        raise Failure("InvalidArgument", "p lies between 0 and 1.")
    ranked, n = _ranked(nodes)

    def row(rank: int, low: int, high: int) -> np.ndarray:
        """The columns from low up to high that are hit; each tile's part of a row has a stream of its own."""
        stream = (1, rank, low // TILE) if low else (1, rank)
        low = low if directed else max(low, rank)
        size = high - low
        if p <= 0 or size <= 0:
            return np.empty(0, np.int64)
        if p >= 1:
            hit = np.arange(size)
        else:
            rng, at, parts = generator(seed, *stream), -1, []
            while at < size:
                jumps = rng.geometric(p, max(16, int((size - at) * p * 1.2) + 8))
                where = at + np.cumsum(np.minimum(jumps, size + 1))
                parts.append(where[where < size])
                at = int(where[-1])
            hit = np.concatenate(parts)
        hit = hit + low
        return hit if selfties else hit[hit != rank]

    def drawn(ranks: Iterator[int], low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for rank in ranks:
            held.append((int(rank), row(int(rank), low, high)))
            size += len(held[-1][1])
            if size > 500_000:  # bounds what a task holds
                yield joined(held)
                held, size = [], 0
        if size:
            yield joined(held)

    def joined(hits: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat([r for r, _ in hits], [len(h) for _, h in hits]), np.concatenate([h for _, h in hits])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x, y in drawn(b["rank"], 0, n):
                yield pd.DataFrame({"a": x, "b": y})

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, own, low, other in zip(*(c.to_pylist() for c in batch.columns)):
                own, other = np.frombuffer(own, np.int64), np.frombuffer(other, np.int64)
                for x, y in drawn(range(at, at + len(own)), low, low + len(other)):
                    yield pa.RecordBatch.from_arrays([pa.array(own[x - at]), pa.array(other[y - low])], names=["src", "dst"])

    if p < SPARSE or not n:
        return _named(ranked.select("rank").mapInPandas(rows, "a long, b long"), ranked)
    wide = min(n, TILE)
    # some 20 million edges or an even share of the rows, but not so few that the ids of the columns outweigh them
    high = min(TILE, max(1024, math.ceil(8 / p), min(math.ceil(2e7 / (p * wide)), math.ceil(n / shuffle_width(nodes.sparkSession)))))
    columns = _strips(ranked, TILE).select(F.col("at").alias("low"), F.col("ids").alias("others"))
    both = _strips(ranked, high).crossJoin(columns)
    both = both if directed else both.where(F.col("low") + TILE > F.col("at"))
    return both.mapInArrow(tiles, "src long, dst long").select("src", "dst", F.lit(1.0).cast("float").alias("value"))


def watts_strogatz(nodes: DataFrame, k: int, beta: float, seed: int) -> DataFrame:
    """Ring lattice with k neighbours; each edge is rewired with probability beta to a node its start is not tied to.

    Proposals that meet an existing edge or one another are drawn again, until none is open.  Only edges whose start is tied to all
    others by then have no place to go, and stay where they were.
    """
    ranked, n = _ranked(nodes)
    if k % 2 or k < 0 or k >= max(n, 1) or not 0 <= beta <= 1:
        raise Failure("InvalidArgument", "k is even and below the number of nodes, beta lies between 0 and 1.")
    lattice = ranked.select(F.col("rank").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("j")) if k else ranked.select(F.col("rank").alias("a"), F.lit(1).alias("j")).limit(0)
    lattice = lattice.select("a", "j", F.pmod(F.col("a") + F.col("j"), F.lit(n)).alias("b"))
    lattice = lattice.withColumn("moved", uniform(seed, "ws", F.col("a"), F.col("j")) < beta)
    lattice = lattice.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "a", "j", "b", "moved").dropDuplicates(["lo", "hi"])
    fixed = cut(lattice.where(~F.col("moved")).select("lo", "hi"))
    open_ = cut(lattice.where("moved").select("a", "j", "b"))
    t = 0
    while not open_.isEmpty():
        t += 1
        # an edge that has not moved holds its place until it does
        held = open_.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        if t % 10 == 0:  # starts that are tied to all others can't be served
            ends = fixed.unionByName(held).select(F.explode(F.array("lo", "hi")).alias("a")).join(open_.select("a").distinct(), "a", "left_semi")
            full = ends.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= n - 1).select("a")
            if open_.join(full, "a", "left_anti").isEmpty():
                break
        aim = F.floor(uniform(seed, "ws-aim", F.lit(t), F.col("a"), F.col("j")) * n).cast("long")
        tried = open_.withColumn("to", aim).withColumn("lo", F.least("a", "to")).withColumn("hi", F.greatest("a", "to"))
        good = tried.where("a <> to").join(fixed, ["lo", "hi"], "left_anti").join(held, ["lo", "hi"], "left_anti").dropDuplicates(["lo", "hi"])
        good = cut(good)
        fixed = cut(fixed.unionByName(good.select("lo", "hi")))
        open_ = cut(open_.join(good.select("a", "j"), ["a", "j"], "left_anti"))
    stay = open_.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    every = fixed.unionByName(stay).distinct()
    return _named(every.select(F.col("lo").alias("a"), F.col("hi").alias("b")), ranked)


def barabasi_albert(nodes: DataFrame, m: int, seed: int) -> DataFrame:
    """Preferential attachment: a clique of the first m + 1 nodes, then m distinct neighbours for each, chosen by degree.

    Edge e of the process has a start that is known and an end copied from a random earlier end; each end is found by
    tracing such copies back with hashed draws (Sanders and Schulz 2016), so that all rows are independent of each other.
    """
    ranked, n = _ranked(nodes)
    if m < 1 or m >= max(n, 1):
        raise Failure("InvalidArgument", "m is at least 1 and below the number of nodes.")
    clique = m * (m + 1) // 2
    first = [(i, j) for i in range(m + 1) for j in range(i)]
    head = np.array([x for pair in first for x in pair], np.int64)

    def end(edge: int, attempt: int) -> int:
        """End of the given edge (numbered from 0, clique first), at the given attempt."""
        while True:
            # a place in the list of all ends before this edge's own node: 2 * (edges before the node)
            node = m + 1 + (edge - clique) // m
            before = 2 * (clique + (node - m - 1) * m)
            place = draw(seed, edge, attempt, before)
            if place < len(head):
                return int(head[place])
            e = place // 2
            if place % 2 == 0:
                return m + 1 + (e - clique) // m
            edge, attempt = e, final_attempt(e)

    memo: dict[int, int] = {}

    def final_attempt(edge: int) -> int:
        """The attempt at which an edge's end differs from those of the earlier edges of its node."""
        if edge not in memo:
            start = clique + ((edge - clique) // m) * m
            taken: set[int] = set()
            for e in range(start, edge + 1):
                t = 0
                while (x := end(e, t)) in taken:
                    t += 1
                taken.add(x)
                memo[e] = t
        return memo[edge]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rank in b["rank"]:
                rank = int(rank)
                if rank <= m:
                    out += [(rank, j) for j in range(rank)]
                else:
                    start = clique + (rank - m - 1) * m
                    out += [(rank, end(e, final_attempt(e))) for e in range(start, start + m)]
                if len(memo) > 500_000:
                    memo.clear()
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    pairs = ranked.select("rank").mapInPandas(rows, "a long, b long")
    return _named(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ranked)


def random_two_mode(nodes: DataFrame, h: int, a: int, seed: int) -> DataFrame:
    """(hyper_name, node_id): each node joins k of the hyperedges aff_0.., k Poisson with mean a, truncated at h."""
    if h < 2 or not 1 <= a <= h:
        raise Failure("InvalidArgument", "h is at least 2 and a between 1 and h.")
    k = np.arange(h + 1)
    logs = k * math.log(a) - a - np.array([math.lgamma(x + 1) for x in k])
    cdf = np.cumsum(np.exp(logs))
    cdf /= cdf[-1]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, names = [], []
            for node in b["node_id"]:
                rng = generator(seed, 4, int(node))
                chosen = rng.choice(h, int(np.searchsorted(cdf, rng.random(), "right").clip(0, h)), replace=False, shuffle=False)
                ids += [int(node)] * len(chosen)
                names += [f"aff_{x}" for x in chosen]
            yield pd.DataFrame({"hyper_name": names, "node_id": np.array(ids, np.int64)})

    return nodes.select("node_id").distinct().mapInPandas(rows, "hyper_name string, node_id long")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
