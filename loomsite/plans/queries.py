"""Queries of the core operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomsite.plans import compare_queries, content_queries, graph_queries, insight_queries, model_queries, page_insight_queries, page_queries, paragraph_queries, search_queries, serp_queries, technical_queries, vector_queries  # noqa: F401
from loomsite.plans.registry import QUERIES, SQL
from loomsite.operators.snapshot_diff import snapshot_changes
from loomsite.plans.stage import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "history"))


def queries() -> dict:
    return {"p1_found": p1_found} | QUERIES


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL} | SQL


P1_SQL = """
with h as (select domain, snapshot_id, rtrim(url, '/') as url, lower(trim(title_hash)) as t, lower(trim(paragraph_hash)) as p,
             row_number() over (partition by domain, snapshot_id, rtrim(url, '/') order by delivered_at desc) as rn
           from history where domain is not null and snapshot_id is not null and url is not null),
x as (select * from h where rn = 1),
s as (select domain, snapshot_id, lag(snapshot_id) over (partition by domain order by snapshot_id) as prev
      from (select distinct domain, snapshot_id from x)),
a as (select x.*, s.prev from x join s using (domain, snapshot_id) where s.prev is not null),
b as (select x.*, s.snapshot_id as nxt from x join s on x.domain = s.domain and x.snapshot_id = s.prev)
select coalesce(a.domain, b.domain) as domain, coalesce(a.snapshot_id, b.nxt) as snapshot_id, coalesce(a.url, b.url) as url,
       case when b.url is null then 'added' when a.url is null then 'removed' else 'changed' end as status
from a full join b on a.domain = b.domain and a.snapshot_id = b.nxt and a.url = b.url
where a.url is null or b.url is null or a.t is distinct from b.t or a.p is distinct from b.p
"""
