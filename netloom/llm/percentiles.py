"""Percentiles of large numeric columns from mergeable dyadic-tree counts (quantile digests).

Values are quantized to an ordered universe of 2**bits cells.  A digest holds counts on nodes of the binary tree
over the universe: node 1 is the root, 2v and 2v+1 are the children of v, and 2**bits + cell is a leaf.  Compression
moves the counts of two siblings to their parent wherever the three hold at most `eps * n / bits` together, so a rank
read from the digest is off by at most eps * n, whatever the data and the order of merging.  Digests are merged by
adding the counts of equal nodes, and are then compressed again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a task gathers before it folds them into its digests.
FOLD_ROWS = 1 << 18


@dataclass(frozen=True)
class Universe:
    """Cells of `width` from `low` on; values outside fall into the first or last cell.

    The default holds every 32-bit integer in a cell of its own.
    """

    bits: int = 32
    low: float = float(-(2**31))
    width: float = 1.0

    def cell(self, value: Column) -> Column:
        at = F.floor((value.cast("double") - self.low) / self.width)
        return F.least(F.greatest(at, F.lit(0)), F.lit(2**self.bits - 1)).cast("long")

    def top(self, cell: Column) -> Column:
        """Largest value of a cell (of whole-number cells: the number itself)."""
        last = self.low + self.width * (cell.cast("double") + 1)
        return last - 1 if self.width == 1.0 else last


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, bits: int, eps: float):
    """Compresses the digests of many groups at once; nodes are unique in each group on return.

    group: numbers from 0; returns the same three arrays, ordered by group and node.
    """
    order = np.lexsort((node, group))
    group, node, count = group[order], node[order], count[order]
    if not len(node):
        return group, node, count
    first = np.r_[True, (group[1:] != group[:-1]) | (node[1:] != node[:-1])]
    starts = np.flatnonzero(first)
    group, node, count = group[starts], node[starts], np.add.reduceat(count, starts)
    total = np.bincount(group, weights=count.astype(float), minlength=int(group.max()) + 1)
    limit = np.floor(total * eps / bits).astype(np.int64)
    may = limit[group] > 0
    if not may.any():
        return group, node, count
    done = [(group[~may], node[~may], count[~may])]
    group, node, count = group[may], node[may], count[may]
    depth = np.frexp(node.astype(float))[1] - 1
    up = (np.empty(0, group.dtype), np.empty(0, node.dtype), np.empty(0, count.dtype))
    for level in range(bits, 0, -1):
        here = depth == level
        g, v, c = (np.concatenate(x) for x in zip(up, (group[here], node[here], count[here])))
        above = depth == level - 1
        pg, pv = np.concatenate((g, group[above])), np.concatenate((v >> 1, node[above]))
        pc = np.concatenate((c, count[above]))
        if not len(g):
            up = (g, v, c)
            continue
        # families: a parent and its children present
        order = np.lexsort((pv, pg))
        edge = np.r_[True, (pg[order][1:] != pg[order][:-1]) | (pv[order][1:] != pv[order][:-1])]
        family = np.empty(len(pg), np.int64)
        family[order] = np.cumsum(edge) - 1
        together = np.bincount(family, weights=pc.astype(float)).astype(np.int64)
        lift = together[family[: len(g)]] <= limit[g]
        done.append((g[~lift], v[~lift], c[~lift]))
        up = (g[lift], v[lift] >> 1, c[lift])
    rest = depth == 0
    g, v, c = (np.concatenate(x) for x in zip(up, (group[rest], node[rest], count[rest]), *done))
    order = np.lexsort((v, g))
    g, v, c = g[order], v[order], c[order]
    starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
    return g[starts], v[starts], np.add.reduceat(c, starts)


def _folder(keys: list[str], bits: int, eps: float, ordered: bool):
    """Arrow batches with keys, node and n to compressed ones.

    ordered: the rows of a group come together, so a finished group is given out and forgotten.  Otherwise all
    groups of the task are held until the end, each compressed.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        size, schema = 0, None

        def folded() -> pd.DataFrame:
            rows = pd.concat(held, ignore_index=True)
            rows["g"] = rows.groupby(keys, dropna=False, sort=False).ngroup()
            names = rows.drop_duplicates("g").set_index("g")[keys]
            g, v, c = compress(rows["g"].to_numpy(), rows["node"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), bits, eps)
            out = names.loc[g].reset_index(drop=True)
            out["node"], out["n"] = v, c
            return out

        def batch(rows: pd.DataFrame) -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(rows, schema=schema, preserve_index=False)

        for b in batches:
            schema = b.schema
            held.append(b.to_pandas(date_as_object=True))
            size += len(held[-1])
            if size >= FOLD_ROWS:
                rows = folded()
                if ordered:
                    last = rows.iloc[-1:][keys]
                    same = np.ones(len(rows), bool)
                    for k in keys:
                        same &= (rows[k] == last[k].iloc[0]) | (rows[k].isna() & pd.isna(last[k].iloc[0]))
                    if (~same).any():
                        yield batch(rows[~same])
                    rows = rows[same]
                held = [rows]
                size = len(rows)
                if not ordered and size > FOLD_ROWS // 2:  # too many groups to hold: what is not merged here is merged later
                    yield batch(rows)
                    held, size = [], 0
        if held and size:
            yield batch(folded())

    return fold


def local_digests(df: DataFrame, keys: list[str], value: str, universe: Universe = Universe(), eps: float = 0.005) -> DataFrame:
    """keys, node, n: digests of each task's own rows, before any shuffle; several per group."""
    leaf = (universe.cell(F.col(value)) + F.lit(2**universe.bits)).alias("node")
    kept = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    rows = df.where(kept).select(*keys, leaf, F.lit(1).cast("long").alias("n"))
    return rows.mapInArrow(_folder(keys, universe.bits, eps, ordered=False), rows.schema)


def merge_digests(digests: DataFrame, keys: list[str], universe: Universe = Universe(), eps: float = 0.005) -> DataFrame:
    """One compressed digest per keys: equal nodes are added (partially before the shuffle), then compressed."""
    added = digests.groupBy(*keys, "node").agg(F.sum("n").alias("n"))
    together = added.repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInArrow(_folder(keys, universe.bits, eps, ordered=True), together.schema)


def read_percentiles(digests: DataFrame, keys: list[str], percents: list[float], universe: Universe = Universe()) -> DataFrame:
    """keys, n, percent, value: the value at rank ceil(percent / 100 * n), at least 1, of each digest."""
    from pyspark.sql.window import Window as W

    bits = universe.bits
    depth = F.floor(F.log2(F.col("node").cast("double")) + 1e-12).cast("int")
    span = (F.lit(bits) - F.col("depth")).cast("int")
    last = F.expr(f"shiftleft(node + 1, {bits} - depth) - 1 - {2**bits}")
    rows = digests.withColumn("depth", depth).withColumn("last", last).withColumn("span", span)
    order = W.partitionBy(*keys).orderBy("last", "span")
    whole = W.partitionBy(*keys)
    rows = rows.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(whole))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("percent")
    rows = rows.select(*keys, "last", "upto", "n", "total", wanted)
    rank = F.greatest(F.lit(1), F.ceil(F.col("percent") * F.col("total") / 100 - 1e-9))
    rows = rows.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    return rows.select(*keys, F.col("total").alias("n"), "percent", universe.top(F.col("last")).alias("value"))


def group_percentiles(
    df: DataFrame, *, keys: list[str], part: str, value: str, percents: list[float], universe: Universe = Universe(), eps: float = 0.005
) -> DataFrame:
    """Percentiles per keys, from digests per `part` (a day, a partition) that are merged by month-like stages.

    Every rank is within eps * n of the true one (exact where n < bits / eps); nulls and NaN are not counted, null
    keys and null parts are groups of their own, groups without a value do not come out, an empty table gives no rows.
    """
    daily = merge_digests(local_digests(df, [*keys, part], value, universe, eps), [*keys, part], universe, eps)
    return read_percentiles(combine_parts(daily, keys, part, universe, eps), keys, percents, universe)


def combine_parts(daily: DataFrame, keys: list[str], part: str, universe: Universe = Universe(), eps: float = 0.005, fan: int = 64) -> DataFrame:
    """One digest per keys from digests per part, over an intermediate stage of `fan` shares so that no task meets all parts."""
    share = F.pmod(F.xxhash64(part), F.lit(fan)).alias("share")
    staged = merge_digests(daily.select(*keys, share, "node", "n"), [*keys, "share"], universe, eps)
    return merge_digests(staged.drop("share"), keys, universe, eps)
