"""Registry of queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: DuckDB expressions on a url.
def sql_domain(u: str) -> str:
    return f"regexp_extract({u}, '^[^:/?#]+://([^/?#]*)', 1)"


def sql_path(u: str) -> str:
    return f"regexp_replace(regexp_extract({u}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"


def sql_query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


def sql_relative(u: str) -> str:
    return f"({sql_path(u)} || case when {sql_query(u)} <> '' then '?' || {sql_query(u)} else '' end)"


#: All anchors of the pages, those with an accepted scheme made absolute (all driver addresses are root-relative).
HREFS = f"""hrefs as (
  select page_id, page_url, {sql_domain('page_url')} as site, unnest(range(len(h)))::int as pos, trim(unnest(h)) as href
  from (select page_id, url as page_url, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) as h from pages)),
links as (
  select *, case when starts_with(href, '/') then regexp_extract(page_url, '^[^:/?#]+://[^/?#]*') || href else href end as url
  from hrefs where href <> '' and not regexp_matches(href, '^(#|javascript:|mailto:|tel:)')),
firsts as (select * from (select *, row_number() over (partition by page_id, url order by pos) as rn from links) where rn = 1)"""

#: The catalogue graph.
CATALOG = """parts as (
  select p_partkey, p_name, regexp_extract(p_brand, '([0-9]+)', 1)::int as bn, (dense_rank() over (order by p_type) - 1)::int as r from part),
cat as (
  select 'supplier-' || l_suppkey || '.example.test' as site, 'https://supplier-' || l_suppkey || '.example.test' as base, l_suppkey as suppkey,
    p_partkey as partkey, p_name as name, bn, r
  from (select distinct l_suppkey, l_partkey from lineitem) join parts on l_partkey = p_partkey),
milli as (
  select *, (case when partkey % 10 = 0 then 500 when partkey % 10 <= 2 then 8000 + 100 * (partkey % 10) else 9000 + 100 * (partkey % 10) end)::int as m from cat),
pedges as (
  select site, base || '/b/' || bn || '/' || r as parent_url, base || '/p/' || partkey || case when frag = 1 then '#reviews' else '' end as url,
    (partkey * 2 + frag)::int as pos, name as title, m as milli, case when m >= 9000 then name end as product_name, partkey, bn, r, frag
  from milli, (values (0), (1)) f(frag) where frag = 0 or partkey % 7 = 0),
pairs as (select distinct site, base, suppkey, bn, r from cat),
wedges as (
  select distinct site, base || '/' as parent_url, base || '/b/' || bn as url, bn as pos, 'Brand ' || bn as title, (7999 - 20 * bn)::int as milli, null::varchar as product_name, bn, -1 as r from pairs
  union all
  select site, base || '/b/' || bn, base || '/b/' || bn || '/' || r, r, 'Type ' || r, (4000 + 50 * bn + 7 * r)::int, null, bn, r from pairs),
edges as (
  select site, parent_url, url, pos, title, milli, product_name from wedges
  union all select site, parent_url, url, pos, title, milli, product_name from pedges)"""
