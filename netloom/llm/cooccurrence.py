"""Pairs of items that share more baskets than chance would have them share.

Baskets with the same deduplicated items are collapsed into one with a weight; pairs are enumerated once for each
distinct basket, and weights are summed.  Items that cannot be in a qualifying pair are dropped before that: with t shared
baskets, item counts a >= b >= t, N baskets and t * N >= lift * a * b it follows that a * lift <= N.

A basket of more than `block` items is not enumerated as a whole.  Ordered by size, the last baskets of an
item whose weights sum to less than its least possible t can't be all that a qualifying pair shares, so these are
not enumerated (prefix filter); what remains of a large basket is enumerated in pairs of blocks, one task each.
The weight of the large baskets is then added, by join, for the candidates alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from netloom.functions.tables import cut, written

BLOCK = 1024


def basket_classes(rows: DataFrame, scope: str, basket: str, item: str) -> DataFrame:
    """(scope, basket, size, weight): one basket for each distinct set of items; rows must be distinct.

    Item sets are compared by their size and two independent order-free 64-bit sums, so that no basket, however
    large, has to be gathered in one place.
    """
    prints = rows.groupBy(scope, basket).agg(
        F.count("*").alias("size"),
        F.bit_xor(F.xxhash64(item)).alias("f1"),
        F.sum(F.shiftright(F.xxhash64(F.lit(7), item), 20)).alias("f2"),
    )
    same = prints.groupBy(scope, "size", "f1", "f2").agg(F.min(basket).alias(basket), F.count("*").alias("weight"))
    return same.select(scope, basket, "size", "weight")


def shared_baskets(
    df: DataFrame, *, scope: str, basket: str, item: str, min_shared: int, lift: float = 0.0, block: int = BLOCK
) -> DataFrame:
    """(scope, item_1, item_2, shared, count_1, count_2, baskets, lift, conviction) of all pairs of items with item_1 < item_2,
    shared >= min_shared and shared * baskets >= lift * count_1 * count_2.

    Each distinct (scope, basket, item) counts once; rows with a null among the three do not count.  lift is how many
    times more often than by chance the pair is shared; conviction is that of the rarer item implying the other, null
    where the rule never fails.  Ties and repeated rows change nothing; an empty table gives no rows; columns
    beyond the three are ignored.

    The rows of the distinct baskets are written once, to the shared folder.
    """
    s, b, i = "scope_", "basket_", "item_"
    facts = df.select(F.col(scope).alias(s), F.col(basket).alias(b), F.col(item).alias(i)).dropna()
    every = facts
    sizes = facts.groupBy(s, b).agg(F.count("*").alias("m")).groupBy(s).agg(F.count("*").alias("baskets"))
    if min_shared > 1:  # an item with too few rows, repeated ones included, has too few baskets
        often = facts.groupBy(s, i).agg(F.count("*").alias("rows_")).where(F.col("rows_") >= min_shared).select(s, i)
        facts = facts.join(often, [s, i], "left_semi")
    facts = facts.distinct()
    counts = facts.groupBy(s, i).agg(F.count("*").alias("count")).join(sizes, s)
    # the least t of an item in any qualifying pair: its partner has at least min_shared baskets
    need = F.greatest(F.lit(min_shared), F.ceil(F.lit(lift * min_shared) * F.col("count") / F.col("baskets") - 1e-9)).cast("long")
    able = cut(counts.where((F.col("count") >= min_shared) & (F.col("count") * lift <= F.col("baskets"))).withColumn("need", need))
    rows = every.join(able.select(s, i, "need"), [s, i]).distinct()
    # items below the threshold are gone, so sets are compared as they then are
    classes = basket_classes(rows, s, b, i)
    # one row for each item of a distinct basket; read by all that follows, so it is written once
    rows = written(rows.join(classes, [s, b]))

    small = rows.where(F.col("size") <= block).select(s, b, i, "weight")
    x, y = small, small.select(s, b, F.col(i).alias("other_"))
    pairs = x.join(y, [s, b]).where(F.col(i) < F.col("other_")).select(s, F.col(i).alias("i1"), F.col("other_").alias("i2"), "weight")

    large = rows.where(F.col("size") > block)
    later = W.partitionBy(s, i).orderBy(F.desc("size"), F.desc(b)).rowsBetween(W.unboundedPreceding, W.currentRow)
    kept = large.withColumn("upto", F.sum("weight").over(later)).where("upto >= need")
    blocks = F.ceil(F.col("size") / block).cast("int")
    kept = kept.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64(i), F.col("blocks")).cast("int"))
    # every two blocks meet once: the lower number of the two is part of the key
    one = kept.withColumn("theirs", F.explode(F.sequence(F.col("mine"), F.col("blocks") - 1))).select(s, b, F.col("mine").alias("u"), F.col("theirs").alias("v"), i)
    two = kept.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("mine")))).select(s, b, F.col("theirs").alias("u"), F.col("mine").alias("v"), F.col(i).alias("other_"))
    met = one.join(two, [s, b, "u", "v"]).where((F.col("u") != F.col("v")) & (F.col(i) != F.col("other_")) | (F.col(i) < F.col("other_")))
    more = met.select(s, F.least(i, "other_").alias("i1"), F.greatest(i, "other_").alias("i2"), F.lit(0).cast("long").alias("weight"))
    found = pairs.unionByName(more).groupBy(s, "i1", "i2").agg(F.sum("weight").alias("shared"))

    held = large.select(s, b, i, "weight")
    extra = (
        found.select(s, "i1", "i2")
        .join(held.withColumnRenamed(i, "i1"), [s, "i1"])
        .join(held.drop("weight").withColumnRenamed(i, "i2"), [s, "i2", b], "left_semi")
        .groupBy(s, "i1", "i2").agg(F.sum("weight").alias("extra"))
    )
    found = found.join(extra, [s, "i1", "i2"], "left").withColumn("shared", F.col("shared") + F.coalesce("extra", F.lit(0)))
    found = found.where(F.col("shared") >= min_shared)
    found = found.join(able.select(s, F.col(i).alias("i1"), F.col("count").alias("c1"), "baskets"), [s, "i1"])
    found = found.join(able.select(s, F.col(i).alias("i2"), F.col("count").alias("c2")), [s, "i2"])
    found = found.where(F.col("shared") * F.col("baskets") >= F.lit(lift) * F.col("c1") * F.col("c2"))
    rate = F.col("shared") / F.least("c1", "c2")
    fails = F.when(rate < 1, (1 - F.greatest("c1", "c2") / F.col("baskets")) / (1 - rate))
    return found.select(
        F.col(s).alias(scope), F.col("i1").alias("item_1"), F.col("i2").alias("item_2"), "shared",
        F.col("c1").alias("count_1"), F.col("c2").alias("count_2"), "baskets",
        (F.col("shared") * F.col("baskets") / (F.col("c1") * F.col("c2"))).alias("lift"), fails.alias("conviction"),
    )
