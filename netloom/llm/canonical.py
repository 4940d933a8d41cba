"""Records that differ only in formatting, found by bottom-up hashing of their normalised structure.

A record is a tree: leaves are columns, inner nodes hold children in a given order or in none.  Leaves are
normalised and hashed; an unordered node sorts the digests of its children before hashing them; records are grouped by the
digest of the root, and a group counts only after its members' normalised structures have been compared in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.tables import cut

#: Copies of one record that meet in one task, and how many records may have more; their list is broadcast.
HOT_ROWS, MAX_HOT = 100_000, 1_000_000


@dataclass(frozen=True)
class Leaf:
    """A column.  `label` keeps letters and digits only, in lower case; `exact` keeps the value as it is."""

    column: str
    kind: str = "exact"

    def columns(self) -> list[str]:
        return [self.column]

    def text(self, df: DataFrame) -> Column:
        c = F.col(f"`{self.column}`")
        if self.kind == "label":
            return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
        if df.schema[self.column].dataType.typeName() in ("double", "float"):
            return F.when(c == 0, F.lit(0.0)).otherwise(c).cast("string")  # -0.0 equals 0.0
        return c.cast("string")


@dataclass(frozen=True)
class Node:
    """Children (leaves or nodes), in order or, if not `ordered`, in any."""

    children: tuple
    ordered: bool = True

    def columns(self) -> list[str]:
        return [c for x in self.children for c in x.columns()]


def _hashed(df: DataFrame, tree, name: str) -> DataFrame:
    """Adds the column `name`: struct of digest (two independent 64-bit hashes) and form (the normalised structure).

    Each level is a projection of its own over the columns of its children, so nothing is computed twice.
    """
    if isinstance(tree, Leaf):
        df = df.withColumn(name, tree.text(df))
        quoted = F.concat(F.lit("'"), F.replace(F.col(name), F.lit("'"), F.lit("''")), F.lit("'"))
        df = df.withColumn(name, F.coalesce(quoted, F.lit("null")))
        return df.withColumn(name, F.struct(F.struct(F.xxhash64(name, F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), name).alias("h2")).alias("d"), F.col(name).alias("f")))
    below = [f"{name}_{k}" for k in range(len(tree.children))]
    for child, column in zip(tree.children, below):
        df = _hashed(df, child, column)
    parts = F.array(*below)
    df = df.withColumn(name, parts if tree.ordered else F.sort_array(parts)).drop(*below)
    digests, forms = F.col(name).getField("d"), F.col(name).getField("f")
    kind = F.lit("ordered" if tree.ordered else "unordered")
    form = F.concat(F.lit("(" if tree.ordered else "{"), F.array_join(forms, ","), F.lit(")" if tree.ordered else "}"))
    return df.withColumn(name, F.struct(F.struct(F.xxhash64(digests, kind).alias("h1"), F.xxhash64(kind, digests).alias("h2")).alias("d"), form.alias("f")))


def collapse(df: DataFrame, tree: Node, *, id: str, required: list[str], hot_rows: int = HOT_ROWS, with_members: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(groups, members).  groups: h1, h2, form, first_id (smallest id), copies; members: first_id, id, one row per record
    that has copies.

    Records with a null in a `required` column belong to no group; elsewhere null equals null.  Labels that are
    empty after normalisation are equal to each other.  Identical rows are copies; rows with a null id never come out.
    Records with one digest and unlike structures (a collision) are groups of their own.  Columns not in the tree are ignored.
    Eager for members (groups with copies are kept in the shared folder); with_members: whether these are wanted at all.
    hot_rows: copies of one record that a task brings together; of the records with more, at most MAX_HOT are split.
    """
    needed = sorted({*tree.columns(), id})
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*required, id])).select(*[F.col(f"`{c}`") for c in needed])
    rows = _hashed(rows, tree, "root_").select(F.col(f"`{id}`").alias("id"), "root_.d.h1", "root_.d.h2", F.col("root_.f").alias("form"))
    groups = rows.groupBy("h1", "h2", "form").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    if not with_members:
        return groups, None
    several = cut(groups.where("copies > 1").select("h1", "h2", F.col("form").alias("agreed"), "first_id", "copies"))
    # digests with very many copies meet their group in several tasks; their list is bounded by MAX_HOT rows of 20 bytes
    hot = several.groupBy("h1", "h2").agg(F.sum("copies").alias("copies")).where(F.col("copies") > hot_rows)
    hot = cut(hot.orderBy(F.desc("copies"), "h1", "h2").limit(MAX_HOT).select("h1", "h2", F.ceil(F.col("copies") / hot_rows).cast("int").alias("shards")))
    if hot.isEmpty():
        members = rows.join(several, ["h1", "h2"])
    else:
        shards = F.coalesce("shards", F.lit(1))
        placed = rows.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("shard", F.pmod(F.xxhash64("id"), shards)).drop("shards")
        spread = several.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1))).drop("shards")
        members = placed.join(spread, ["h1", "h2", "shard"])
    members = members.where(F.col("form") == F.col("agreed")).select("first_id", "id")
    return groups, members


CALL_EDGE = Node((Leaf("layer"), Leaf("value"), Node((Leaf("node1", "label"), Leaf("node2", "label")), ordered=False)))
