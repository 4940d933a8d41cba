"""Queries of the general data problems (3, 4 and 6) and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.tables import table
from netloom.operators.orphans import orphan_references, orphan_report
from netloom.operators.parse_errors import parse_lines
from netloom.operators.skew import dominant_keys, fragment_replicate_join, key_profile


def _references(spark: SparkSession, d: str) -> DataFrame:
    edges, members = table(spark, d, "trade_edges"), table(spark, d, "affiliations")
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("ref_field"), F.col(c).alias("ref")) for c in ("from", "to")]))
    edges = edges.select("row_id", F.col("seen_at").alias("at"), ends.alias("x")).select(F.lit("trade_edges").alias("tab"), "row_id", "x.*", "at")
    members = members.select(F.lit("affiliations").alias("tab"), "row_id", F.lit("node").alias("ref_field"), F.col("node").alias("ref"), F.col("seen_at").alias("at"))
    return edges.unionByName(members)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(_references(spark, d), table(spark, d, "lazega_nodes"), payload=["tab", "row_id", "ref_field"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("tab", "row_id", "ref_field")


def p3_orphans(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("tab", "row_id", "ref_field", F.col("ref").alias("node_id"), F.col("at").alias("seen_at"), "reason")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d), by=["tab", "ref_field"])


_REFS = """
refs as (
  select 'trade_edges' as tab, row_id, 'from' as ref_field, "from" as k, seen_at from trade_edges
  union all select 'trade_edges', row_id, 'to', "to", seen_at from trade_edges
  union all select 'affiliations', row_id, 'node', node, seen_at from affiliations),
orphans as (
  select * from refs r where k is not null and not exists (
    select 1 from lazega_nodes n where n.node_id = r.k and n.registered_at <= r.seen_at
    and (n.deleted_at is null or r.seen_at < n.deleted_at))),
reasoned as (
  select *, case
    when k not in (select node_id from lazega_nodes where node_id is not null) then 'unknown'
    when seen_at is null then 'undated'
    when exists (select 1 from lazega_nodes n where n.node_id = o.k and n.registered_at <= o.seen_at
      and (n.deleted_at is null or n.deleted_at > n.registered_at)) then 'deleted'
    else 'early' end as reason from orphans o)
"""


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(table(spark, d, "edgelist_lines"), table(spark, d, "edgelist_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("reason is not null").select("line_id")


def p4_edges(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("reason is null").select("line_id", "layer", "from", "to", F.col("value").cast("double").alias("value"))


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("reason is not null").groupBy("file_id", "reason").agg(F.count("*").alias("n_lines"))


_LINES = r"""
raw as (
  select l.line_id, l.file_id, f.layer, f.sep_char as s, regexp_replace(l.raw_line, '\r\z', '') as t
  from edgelist_lines l join edgelist_files f using (file_id) where not (f.has_header and l.line_no = 1)),
lines as (select *, case when s = '|' then '\|' else s end as p from raw where not regexp_full_match(t, '[ \t]*')),
shaped as (select *,
  regexp_full_match(t, '(("([^"]|"")*"|[^"' || p || ']*)' || p || ')*("([^"]|"")*"|[^"' || p || ']*)') as quoted_right,
  regexp_extract(t, '^("(?:[^"]|"")*"|[^"' || p || ']*)' || p || '("(?:[^"]|"")*"|[^"' || p || ']*)' || p || '("(?:[^"]|"")*"|[^"' || p || ']*)$', 1) as xa,
  regexp_extract(t, '^("(?:[^"]|"")*"|[^"' || p || ']*)' || p || '("(?:[^"]|"")*"|[^"' || p || ']*)' || p || '("(?:[^"]|"")*"|[^"' || p || ']*)$', 2) as xb,
  regexp_extract(t, '^("(?:[^"]|"")*"|[^"' || p || ']*)' || p || '("(?:[^"]|"")*"|[^"' || p || ']*)' || p || '("(?:[^"]|"")*"|[^"' || p || ']*)$', 3) as xc,
  regexp_full_match(t, '("([^"]|"")*"|[^"' || p || ']*)' || p || '("([^"]|"")*"|[^"' || p || ']*)' || p || '("([^"]|"")*"|[^"' || p || ']*)') as three
  from lines),
bare as (select *, trim(case when xa[1] = '"' then xa[2:-2] else xa end, ' ') as a,
  trim(case when xb[1] = '"' then xb[2:-2] else xb end, ' ') as b,
  trim(case when xc[1] = '"' then xc[2:-2] else xc end, ' ') as c from shaped),
judged as (select *, case
  when not quoted_right then 'quoting' when not three then 'column count'
  when not (regexp_full_match(a, '[0-9]+') and regexp_full_match(b, '[0-9]+')
    and regexp_full_match(c, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
    and coalesce(try_cast(a as hugeint) <= 4294967295, false) and coalesce(try_cast(b as hugeint) <= 4294967295, false)
    and coalesce(abs(try_cast(c as double)) <= 3.4028234663852886e38, false)) then 'invalid value' end as reason from bare)
"""


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return dominant_keys(table(spark, d, "affiliations"), scope="layer", fields=("affiliation", "node"))


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    return key_profile(table(spark, d, "affiliations"), scope="layer", fields=("affiliation", "node"))


def p6_offices(spark: SparkSession, d: str) -> DataFrame:
    """Memberships per layer and office of the member's first registration: a join on the skewed key."""
    register = table(spark, d, "lazega_nodes").where("node_id is not null")
    first = register.groupBy(F.col("node_id").alias("node")).agg(F.min(F.struct("rec_id", "Office")).alias("r")).select("node", F.col("r.Office").alias("Office"))
    members = table(spark, d, "affiliations").select("layer", "node")
    return fragment_replicate_join(members, first, ["node"]).groupBy("layer", "Office").agg(F.count("*").alias("memberships"))


_PROFILE = """
totals as (select layer, count(*) as scope_rows from affiliations group by layer),
profile as (
  select layer, 'affiliation' as key_field, affiliation as key_value, count(*) as n_rows, count(distinct node) as n_partners
  from affiliations where affiliation is not null group by layer, affiliation
  union all select layer, 'node', cast(node as varchar), count(*), count(distinct affiliation)
  from affiliations where node is not null group by layer, node)
"""

QUERIES = {
    "p3_found": p3_found, "p3_orphans": p3_orphans, "p3_report": p3_report,
    "p4_found": p4_found, "p4_edges": p4_edges, "p4_reasons": p4_reasons,
    "p6_found": p6_found, "p6_profile": p6_profile, "p6_offices": p6_offices,
}

SQL = {
    "p3_found": f"with {_REFS} select tab, row_id, ref_field from orphans",
    "p3_orphans": f"with {_REFS} select tab, row_id, ref_field, k as node_id, seen_at, reason from reasoned",
    "p3_report": f"with {_REFS} select tab, ref_field, cast(date_trunc('month', seen_at) as date) as month, reason, count(*) as orphans from reasoned group by all",
    "p4_found": f"with {_LINES} select line_id from judged where reason is not null",
    "p4_edges": f'with {_LINES} select line_id, layer, cast(a as bigint) as "from", cast(b as bigint) as "to", cast(cast(c as float) as double) as value from judged where reason is null',
    "p4_reasons": f"with {_LINES} select file_id, reason, count(*) as n_lines from judged where reason is not null group by all",
    "p6_found": f"with {_PROFILE} select p.layer, key_field, key_value from profile p join totals t on p.layer = t.layer where 20 * n_rows >= scope_rows",
    "p6_offices": """with r as (select node_id, arg_min(coalesce(Office, '?'), rec_id) as o from lazega_nodes where node_id is not null group by node_id)
  select layer, nullif(o, '?') as Office, count(*) as memberships from affiliations join r on node = node_id group by all""",
    "p6_profile": f"with {_PROFILE} select p.layer, key_field, key_value, n_rows, n_partners, scope_rows from profile p join totals t on p.layer = t.layer",
}
