"""Per-key results over data in which a few keys hold most rows.

Fragment-replicate by estimated load: keys are bin-packed to tasks by their load; a key too large for a task is
split into shards in proportion to its load; rows of the other side of a join go only to the shards of their key.

Loads are exact counts (map-side combined).  What reaches the driver is bounded by the number of tasks: the keys
heavier than a task's share divided by SHARE, of which there can be at most tasks * SHARE, and the summed loads of
tasks * SHARE hash ranges of all lighter keys.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.tables import shuffle_width

#: A key or shard holds at most 1/SHARE of the mean load of a task.
SHARE = 4


@dataclass
class LoadPlan:
    """Where rows go: `heavy` (h1, h2, shards, base) is one row per split key, `bins` the bin of each unit."""

    tasks: int
    heavy: DataFrame
    n_heavy: int
    bins: list[int]
    loads: list[int]

    def _place(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Adds shards and base of split keys (null for others)."""
        if not self.n_heavy:
            return df.withColumns({"shards": F.lit(None).cast("int"), "base": F.lit(None).cast("int")})
        h1, h2 = _fingerprint(keys)
        return df.withColumns({"h1_": h1, "h2_": h2}).join(
            F.broadcast(self.heavy.withColumnsRenamed({"h1": "h1_", "h2": "h2_"})), ["h1_", "h2_"], "left"
        ).drop("h1_", "h2_")

    def _to_bin(self, df: DataFrame, keys: list[str], shard: Column) -> DataFrame:
        """Adds the bin of each row's unit, a shard or a range of light keys; the list of units has at most 2 * tasks * SHARE rows."""
        unit = F.coalesce(F.col("base") + shard, _range(keys, self.tasks * SHARE))
        units = df.sparkSession.createDataFrame(list(enumerate(self.bins)), "unit_ int, bin int")
        return df.withColumn("unit_", unit).join(F.broadcast(units), "unit_").drop("unit_")

    def fragment(self, df: DataFrame, keys: list[str], spread_by: list[str]) -> DataFrame:
        """Rows in the task of their bin, with `split` (whether the key has shards).

        Equal `spread_by` of a key meet in one task, so distinct counts of a key's tasks add up.
        """
        shard = F.pmod(F.xxhash64(*spread_by), F.col("shards")).cast("int")
        df = self._to_bin(self._place(df, keys), keys, shard)
        return df.withColumn("split", F.col("shards").isNotNull()).drop("shards", "base").repartition(self.tasks, "bin")

    def divided(self, df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """The rows of keys that stay whole, and of those that are split."""
        if not self.n_heavy:
            return df, df.limit(0)
        df = self._place(df, keys)
        return df.where("shards is null").drop("shards", "base"), df.where("shards is not null").drop("shards", "base")

    def replicate(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of the other side, one copy in each task that has a shard of their key, and in no other."""
        df = self._place(df, keys)
        df = df.withColumn("shard_", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shards"), F.lit(1)) - 1)))
        df = self._to_bin(df, keys, F.col("shard_")).drop("shards", "base", "shard_")
        return df.distinct().repartition(self.tasks, "bin")


def _fingerprint(keys: list[str]) -> tuple[Column, Column]:
    return F.xxhash64(*keys), F.hash(*keys)


def _range(keys: list[str], ranges: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("light"), *keys), F.lit(ranges)).cast("int")


def _labels(spark, tasks: int) -> list[int]:
    """For each task a number that hash partitioning sends to it, so that bins don't meet in one task."""
    found: dict[int, int] = {}
    size = tasks * 32
    while len(found) < tasks:
        number = F.col("id").cast("int")
        least = spark.range(size).groupBy(F.pmod(F.hash(number), F.lit(tasks)).alias("p")).agg(F.min(number).alias("n"))
        found = {r["p"]: r["n"] for r in least.collect()}  # a row for each task
        size *= 4
    return [found[p] for p in range(tasks)]


def plan_loads(df: DataFrame, keys: list[str], tasks: int | None = None) -> LoadPlan:
    """Bin-packs the keys of the rows of `df` to tasks, largest first to the least loaded task."""
    spark = df.sparkSession
    tasks = tasks or shuffle_width(spark)
    parts = tasks * SHARE
    most = max(1, -(-df.count() // parts))
    loads = df.groupBy(*keys).agg(F.count("*").alias("n"))
    heavy = F.col("n") > most
    h1, h2 = _fingerprint(keys)
    units_of = loads.select(F.when(heavy, h1).alias("h1"), F.when(heavy, h2).alias("h2"), F.when(~heavy, _range(keys, parts)).alias("u"), "n")
    found = units_of.groupBy("h1", "h2", "u").agg(F.sum("n").alias("n")).collect()  # at most 2 * parts rows
    units = [0] * parts
    rows = []
    for r in found:
        if r["u"] is not None:
            units[r["u"]] = r["n"]
    for r in sorted((r for r in found if r["u"] is None), key=lambda r: (r["h1"], r["h2"])):
        shards = -(-r["n"] // most)
        rows.append((r["h1"], r["h2"], shards, len(units)))
        units += [-(-r["n"] // shards)] * shards
    labels = _labels(spark, tasks)
    queue = [(0, t) for t in range(tasks)]
    bins = [0] * len(units)
    for u in sorted(range(len(units)), key=lambda u: (-units[u], u)):
        used, t = heapq.heappop(queue)
        bins[u] = labels[t]
        heapq.heappush(queue, (used + units[u], t))
    table = spark.createDataFrame(rows, "h1 long, h2 int, shards int, base int")
    return LoadPlan(tasks, table, len(rows), bins, [n for n, _ in sorted(queue, key=lambda x: x[1])])


def _profile_of(rows: DataFrame, key: str, partner: str, tasks: int | None) -> DataFrame:
    """scope, key, n_rows, n_partners.  Keys that were not split are finished in their task; shards are added up.

    Rows of split keys are first put together by partner, with partial sums before the exchange, so that neither a partner that
    is null nor one that holds most rows of its key makes a shard heavy.
    """
    rows = rows.where(F.col(key).isNotNull()).select("scope", key, partner)
    ends = ["scope", key]
    plan = plan_loads(rows, ends, tasks)
    light, heavy = plan.divided(rows, ends)
    placed = plan.fragment(light, ends, [partner])
    grouped = placed.groupBy("bin", *ends, partner).agg(F.count("*").alias("n"))
    whole = grouped.groupBy("bin", *ends).agg(F.sum("n").alias("n_rows"), F.count(partner).alias("n_partners")).drop("bin")
    if not plan.n_heavy:
        return whole
    heavy = plan.fragment(heavy.groupBy(*ends, partner).agg(F.count("*").alias("n")), ends, [partner])
    shards = heavy.groupBy("bin", *ends).agg(F.sum("n").alias("n_rows"), F.count(partner).alias("n_partners"))
    shards = shards.groupBy(*ends).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_partners").alias("n_partners"))
    return whole.unionByName(shards)


def key_profile(df: DataFrame, *, scope: str, fields: tuple[str, str], tasks: int | None = None) -> DataFrame:
    """Rows and distinct partners of each key of both fields within its scope, and the rows of the scope.

    Out: scope column, key_field, key_value (string), n_rows (repeated rows included), n_partners (distinct non-null
    values of the other field), scope_rows (all rows of the scope, those with null keys included).
    Null keys get no row; a null scope is a scope of its own; an empty table gives no rows; other columns are ignored.
    """
    rows = df.select(F.col(scope).alias("scope"), *[F.col(f).alias(f"f{k}") for k, f in enumerate(fields)])
    out = None
    for k, field in enumerate(fields):
        part = _profile_of(rows, f"f{k}", f"f{1 - k}", tasks)
        part = part.select("scope", F.lit(field).alias("key_field"), F.col(f"f{k}").cast("string").alias("key_value"), "n_rows", "n_partners")
        out = part if out is None else out.unionByName(part)
    scopes = rows.groupBy(F.col("scope").alias("of")).agg(F.count("*").alias("scope_rows"))
    joined = out.join(scopes, F.col("scope").eqNullSafe(F.col("of")))
    return joined.select(F.col("scope").alias(scope), "key_field", "key_value", "n_rows", "n_partners", "scope_rows")


def dominant_keys(df: DataFrame, *, scope: str, fields: tuple[str, str], share: int = 20, tasks: int | None = None) -> DataFrame:
    """Keys with at least 1/share of all rows of their scope."""
    profile = key_profile(df, scope=scope, fields=fields, tasks=tasks)
    return profile.where(F.col("n_rows") * share >= F.col("scope_rows")).select(scope, "key_field", "key_value")


def fragment_replicate_join(facts: DataFrame, side: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Inner equi-join of a skewed table with one that has few rows per key; columns of `facts`, then those of `side`.

    Each row of `facts` is moved once; a row of `side` only to the tasks with a shard of its key.  Identical rows of
    `side` count once.  Null keys match nothing.  Other columns of the two must not share names.
    """
    facts, side = (df.where(" and ".join(f"`{k}` is not null" for k in keys)) for df in (facts, side))
    plan = plan_loads(facts, keys, tasks)
    left = plan.fragment(facts, keys, [F.struct(*[F.col(f"`{c}`") for c in facts.columns])]).drop("split")
    return left.join(plan.replicate(side.select(*side.columns), keys), ["bin", *keys]).drop("bin")
