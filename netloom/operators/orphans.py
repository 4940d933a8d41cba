"""References to records that do not exist, do not exist yet, or no longer exist.

The parent keys are compressed into contiguous runs [first, last].  References and runs are merged in
key order, every reference is matched as of the preceding run start, and a reference beyond that run's end
has no parent at all.  The same pass matches a reference as of the preceding lifetime start of its key in
time, so that references before the first registration or after a deletion come out as well.

Both matches are one sort by (bucket of keys, key, time) and two running aggregates: no range join, nothing
broadcast but the list of hot keys, whose length is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from netloom.functions.tables import cut

#: Keys per bucket, as a power of two.  A run is cut at bucket borders, so buckets are independent.
BUCKET_BITS = 10
#: A key with more references than this (or than total / MAX_HOT, if that is more) is split into shards.
HOT_ROWS = 200_000
#: At most so many keys can be hot, however large the input; their list (some 20 MB) is the only thing broadcast.
MAX_HOT = 1_000_000


def key_runs(parents: DataFrame, key: str, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """(bucket, first, last): contiguous runs of the distinct non-null integer keys, cut at bucket borders."""
    keys = parents.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct()
    keys = keys.withColumn("bucket", F.shiftright("k", bucket_bits))
    order = W.partitionBy("bucket").orderBy("k")
    keys = keys.withColumn("island", F.col("k") - F.row_number().over(order))
    return keys.groupBy("bucket", "island").agg(F.min("k").alias("first"), F.max("k").alias("last")).drop("island")


def lifetimes(parents: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(k, start, end): one row per key and start, without lifetimes that an open-ended earlier one contains."""
    kind = parents.schema[start].dataType
    never = F.lit("9999-12-31 00:00:00").cast(kind)
    rows = parents.select(
        F.col(key).cast("long").alias("k"), F.col(start).alias("start"), F.coalesce(F.col(end), never).alias("end")
    ).where("k is not null and start is not null and start < end")
    rows = rows.groupBy("k", "start").agg(F.max("end").alias("end"))
    opened = rows.where(F.col("end") == never).groupBy("k").agg(F.min("start").alias("opened"))
    rows = rows.join(opened, "k", "left")
    return rows.where("opened is null or start <= opened").drop("opened")


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    *,
    payload: list[str],
    ref: str = "ref",
    at: str = "at",
    key: str = "node_id",
    start: str = "registered_at",
    end: str = "deleted_at",
    bucket_bits: int = BUCKET_BITS,
    hot_rows: int = HOT_ROWS,
    max_hot: int = MAX_HOT,
) -> DataFrame:
    """Every reference without a parent in force at its time: payload columns, `ref`, `at` and `reason`.

    A reference holds if some parent row has that key with start <= at and (end null or at < end).

    reason is `unknown` (no such key), `early` (known, but no lifetime began by then), `deleted` (every lifetime
    begun by then had ended) or `undated` (known key, but the reference has no time).  Null references are not
    references and never come out; parents with a null key or start, or with an end not after the start, hold
    nothing; repeated references come out once each; an empty parent table makes every reference `unknown`.
    Columns of either table that are not named here are ignored, whatever they are called.
    """
    when = refs.schema[at].dataType
    rows = refs.select(
        F.col(ref).cast("long").alias("k"), F.col(at).alias("t"), F.struct(*payload).alias("body")
    ).where("k is not null")

    limit = max(hot_rows, rows.count() // max_hot)
    loads = rows.groupBy("k").count().where(F.col("count") > limit)
    hot_keys = cut(loads.select("k", F.ceil(F.col("count") / limit).cast("int").alias("shards")))  # max_hot rows at most, and never on the driver
    hot = not hot_keys.isEmpty()

    def place(df: DataFrame, shard) -> DataFrame:
        """Adds bucket and shard; hot keys get a bucket of their own and the given shard(s)."""
        df = df.withColumn("bucket", F.shiftright("k", bucket_bits)).withColumn("shard", F.lit(-1))
        if not hot:
            return df
        df = df.join(F.broadcast(hot_keys), "k", "left")
        return df.withColumn("shard", F.when(F.col("shards").isNull(), F.col("shard")).otherwise(shard(df))).drop("shards")

    def spread(df: DataFrame) -> DataFrame:
        """Parent rows of hot keys go to all shards of their key."""
        df = df.withColumn("bucket", F.shiftright("k", bucket_bits)).withColumn("shard", F.lit(-1))
        if not hot:
            return df
        copies = F.when(F.col("shards").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("shards") - 1))
        return df.join(F.broadcast(hot_keys), "k", "left").withColumn("shard", F.explode(copies)).drop("shards")

    body = rows.schema["body"].dataType
    nothing = F.lit(None)
    runs = key_runs(parents, key, bucket_bits)
    run_rows = runs.select("bucket", F.lit(-1).alias("shard"), F.col("first").alias("k"), "last")
    if hot:  # the shards of a hot key need to know whether the key exists
        inside = runs.join(
            F.broadcast(hot_keys.withColumn("bucket", F.shiftright("k", bucket_bits))), "bucket"
        ).where("k between first and last")
        run_rows = run_rows.unionByName(
            inside.select("bucket", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "k", F.col("k").alias("last"))
        )
    run_rows = run_rows.select(
        "bucket", "shard", "k", nothing.cast(when).alias("t"), F.lit(0).alias("kind"), "last",
        nothing.cast(when).alias("end"), nothing.cast(body).alias("body"),
    )
    life_rows = spread(lifetimes(parents, key, start, end).withColumnRenamed("start", "t")).select(
        "bucket", "shard", "k", F.col("t").cast(when).alias("t"), F.lit(1).alias("kind"), nothing.cast("long").alias("last"),
        F.col("end").cast(when).alias("end"), nothing.cast(body).alias("body"),
    )
    ref_rows = place(rows, lambda df: F.pmod(F.xxhash64("t", "body"), F.col("shards")).cast("int")).select(
        "bucket", "shard", "k", "t", F.lit(2).alias("kind"), nothing.cast("long").alias("last"),
        nothing.cast(when).alias("end"), "body",
    )

    order = W.partitionBy("bucket", "shard").orderBy("k", F.col("t").asc_nulls_first(), "kind")
    order = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = run_rows.unionByName(life_rows).unionByName(ref_rows)
    merged = merged.withColumn("run_end", F.last("last", ignorenulls=True).over(order))
    # keys ascend, so the greatest (key, end) so far is the latest end among this key's lifetimes begun by now
    merged = merged.withColumn("life", F.max(F.when(F.col("kind") == 1, F.struct("k", "end"))).over(order))
    reason = (
        F.when(F.col("run_end").isNull() | (F.col("k") > F.col("run_end")), "unknown")
        .when(F.col("t").isNull(), "undated")
        .when(F.col("life").isNull() | (F.col("life.k") < F.col("k")), "early")
        .when(F.col("life.end") <= F.col("t"), "deleted")
    )
    found = merged.where("kind = 2").withColumn("reason", reason).where("reason is not null")
    return found.select("body.*", F.col("k").alias(ref), F.col("t").alias(at), "reason")


def orphan_report(orphans: DataFrame, *, by: list[str], at: str = "at") -> DataFrame:
    """Number of orphans per `by`, month of `at` (first day; null for undated) and reason."""
    month = F.trunc(F.col(at).cast("date"), "month").alias("month")
    return orphans.groupBy(*by, month, "reason").agg(F.count("*").alias("orphans"))
