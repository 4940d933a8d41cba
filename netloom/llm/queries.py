"""Queries of the training-data problems 1, 2, 5, 7, 8 and 9, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.tables import table
from netloom.llm.canonical import CALL_EDGE, collapse
from netloom.llm.contamination import leaked_items
from netloom.llm.cooccurrence import shared_baskets
from netloom.llm.packing import pack_texts
from netloom.llm.percentiles import combine_parts, local_digests, merge_digests, read_percentiles
from netloom.llm.toxicity import Classifier, cut_documents, rates, score_cut, train_on_cut

PERCENTS = [1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0]
EPS = 0.005


def _measures(spark: SparkSession, d: str) -> DataFrame:
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("Age", "YearsWithFirm")]))
    return table(spark, d, "lazega_nodes").select("Office", "load_day", fields.alias("x")).select("Office", "load_day", "x.*")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    keys = ["Office", "field", "load_day"]
    return merge_digests(local_digests(_measures(spark, d), keys, "value", eps=EPS), keys, eps=EPS)


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    keys = ["Office", "field"]
    merged = combine_parts(_daily(spark, d), keys, "load_day", eps=EPS)
    return read_percentiles(merged, keys, PERCENTS).withColumn("value", F.col("value").cast("long"))


def p1_rank_errors(spark: SparkSession, d: str) -> DataFrame:
    """Whether every percentile's rank, counted exactly, is within the stated bound."""
    got = p1_percentiles(spark, d)
    counts = _measures(spark, d).where("value is not null").groupBy("Office", "field", "value").count()
    counts = counts.select(F.col("Office").alias("o"), F.col("field").alias("f"), F.col("value").alias("v"), F.col("count").alias("c"))
    both = got.join(counts, F.col("Office").eqNullSafe(F.col("o")) & (F.col("field") == F.col("f")))
    at = both.groupBy("Office", "field", "percent", "n", "value").agg(
        F.sum(F.when(F.col("v") <= F.col("value"), F.col("c")).otherwise(0)).alias("upto"),
        F.sum(F.when(F.col("v") < F.col("value"), F.col("c")).otherwise(0)).alias("below"),
    )
    rank = F.greatest(F.lit(1), F.ceil(F.col("percent") * F.col("n") / 100 - 1e-9))
    off = F.greatest(F.col("below") + 1 - rank, rank - F.col("upto"), F.lit(0))
    return at.select("Office", "field", "percent", "n", (off <= F.lit(EPS) * F.col("n")).alias("within_bound"))


def _percent_sql(columns: str) -> str:
    return f"""
with m as (select Office, 'Age' as field, Age as value from lazega_nodes union all select Office, 'YearsWithFirm', YearsWithFirm from lazega_nodes),
r as (select Office, field, value, row_number() over (partition by Office, field order by value) as k, count(*) over (partition by Office, field) as n from m where value is not null),
q as (select unnest([1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0])::double as percent)
select Office, field, n, percent, {columns} from r, q where k = greatest(1, ceil(percent * n / 100 - 1e-9))"""


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = shared_baskets(table(spark, d, "affiliations"), scope="layer", basket="affiliation", item="node", min_shared=6, lift=4.0)
    return pairs.select("layer", F.col("item_1").alias("node_1"), F.col("item_2").alias("node_2"))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs sharing at least three hyperedges, with lift and conviction, at or above what chance would give."""
    pairs = shared_baskets(table(spark, d, "affiliations"), scope="layer", basket="affiliation", item="node", min_shared=3, lift=1.0)
    return pairs.select("layer", F.col("item_1").alias("node_1"), F.col("item_2").alias("node_2"), "shared", "lift", "conviction")


def p2_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs that share a hyperedge, rarer than by chance or not, with lift and conviction."""
    pairs = shared_baskets(table(spark, d, "affiliations"), scope="layer", basket="affiliation", item="node", min_shared=1, lift=0.0)
    return pairs.select("layer", F.col("item_1").alias("node_1"), F.col("item_2").alias("node_2"), "shared", "lift", "conviction")


_BASKETS = """
af as (select distinct layer, affiliation, node from affiliations where layer is not null and affiliation is not null and node is not null),
big as (select layer, count(distinct affiliation) as baskets from af group by layer),
cnt as (select layer, node, count(*) as c from af group by layer, node),
ok as (select * from af semi join cnt on af.layer = cnt.layer and af.node = cnt.node and cnt.c >= {t}),
pairs as (select x.layer, x.node as node_1, y.node as node_2, count(*) as shared from ok x join ok y
  on x.layer = y.layer and x.affiliation = y.affiliation and x.node < y.node group by all having count(*) >= {t}),
scored as (select p.*, c1.c as a, c2.c as b, baskets from pairs p join cnt c1 on p.layer = c1.layer and node_1 = c1.node
  join cnt c2 on p.layer = c2.layer and node_2 = c2.node join big on p.layer = big.layer where shared * baskets >= {lift} * c1.c * c2.c)
"""


def _copies(spark: SparkSession, d: str, with_members: bool) -> tuple[DataFrame, DataFrame | None]:
    return collapse(table(spark, d, "call_edges"), CALL_EDGE, id="row_id", required=["node1", "node2"], with_members=with_members)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    members = _copies(spark, d, True)[1].where("id <> first_id")
    return members.select(F.col("first_id").alias("row_id_1"), F.col("id").alias("row_id_2"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for each set of copies, with their number."""
    return _copies(spark, d, False)[0].select(F.col("first_id").alias("row_id"), "copies")


_LABELS = r"""
r as (select row_id, layer, value + 0.0 as value, lower(regexp_replace(node1, '[^\p{L}\p{N}]', '', 'g')) as a,
  lower(regexp_replace(node2, '[^\p{L}\p{N}]', '', 'g')) as b from call_edges where node1 is not null and node2 is not null),
g as (select *, min(row_id) over (partition by layer, value, least(a, b), greatest(a, b)) as first_id from r)
"""

def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    """For each packing: texts packed, and texts or containers that break a rule (all of these are 0)."""
    rows = p7_containers(spark, d)
    texts = rows.groupBy("pack_name", "doc_id").agg(
        F.count("*").alias("parts"), F.max("part").alias("last"), F.sum("n_tokens").alias("tokens"), F.max("capacity").alias("capacity")
    )
    split = (F.col("parts") != F.ceil(F.col("tokens") / F.col("capacity"))) | (F.col("last") != F.col("parts") - 1)
    texts = texts.groupBy("pack_name").agg(F.count("*").alias("texts"), F.count(F.when(split, 1)).alias("wrongly_split"))
    bins = rows.groupBy("pack_name", "container", "capacity", "used").agg(F.sum("n_tokens").alias("tokens"))
    wrong = (F.col("tokens") != F.col("used")) | (F.col("used") > F.col("capacity"))
    bins = bins.groupBy("pack_name").agg(F.count(F.when(wrong, 1)).alias("overfull"))
    return texts.join(bins, "pack_name")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """For each packing: containers, the least possible number by volume, and the part of the room that is used."""
    rows = p7_containers(spark, d).groupBy("pack_name", "capacity").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return rows.withColumns({"at_least": F.ceil(F.col("tokens") / F.col("capacity")), "fill": F.col("tokens") / (F.col("containers") * F.col("capacity"))})


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_suites(spark: SparkSession, d: str) -> DataFrame:
    """Items leaked and documents concerned, per suite."""
    items = table(spark, d, "eval_items").select("item_id", "suite")
    return p8_found(spark, d).join(items, "item_id").groupBy("suite").agg(F.countDistinct("item_id").alias("items"), F.countDistinct("doc_id").alias("documents"))


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, Classifier]:
    """Scores of all documents, which are cut once, and the model."""
    documents = cut_documents(table(spark, d, "documents"))
    model = train_on_cut(documents, table(spark, d, "abuse_labels"))
    return score_cut(documents, model), model


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)[0]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    scored, model = _judged(spark, d)
    return scored.where(F.col("score") >= model.threshold).select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    scored, model = _judged(spark, d)
    return rates(scored, model.threshold)


QUERIES = {
    "p1_percentiles": p1_percentiles, "p1_rank_errors": p1_rank_errors,
    "p2_found": p2_found, "p2_pairs": p2_pairs, "p2_all_pairs": p2_all_pairs,
    "p5_found": p5_found, "p5_records": p5_records,
    "p7_containers": p7_containers, "p7_audit": p7_audit, "p7_fill": p7_fill,
    "p8_found": p8_found, "p8_suites": p8_suites,
    "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates,
}

SQL = {
    "p1_percentiles": _percent_sql("cast(value as bigint) as value"),
    "p1_rank_errors": _percent_sql("true as within_bound"),
    "p2_found": f"with {_BASKETS.format(t=6, lift=4)} select layer, node_1, node_2 from scored",
    "p2_pairs": f"""with {_BASKETS.format(t=3, lift=1)} select layer, node_1, node_2, shared, cast(shared * baskets as double) / (a * b) as lift,
  case when shared < least(a, b) then (1 - greatest(a, b) / baskets) / (1 - shared / least(a, b)) end as conviction from scored""",
    "p2_all_pairs": f"""with {_BASKETS.format(t=1, lift=0)} select layer, node_1, node_2, shared, cast(shared * baskets as double) / (a * b) as lift,
  case when shared < least(a, b) then (1 - greatest(a, b) / baskets) / (1 - shared / least(a, b)) end as conviction from scored""",
    "p5_found": f"with {_LABELS} select first_id as row_id_1, row_id as row_id_2 from g where row_id <> first_id",
    "p7_audit": """select pack_name, count(*) as texts, 0::bigint as wrongly_split, 0::bigint as overfull
  from pack_sizes, documents where text <> '' group by pack_name""",
    "p5_records": f"with {_LABELS} select first_id as row_id, count(*) as copies from g group by 1",
}
