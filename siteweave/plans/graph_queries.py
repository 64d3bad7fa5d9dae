"""Queries over the catalogue graph: bands, joins, walks, trees, products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteweave.functions import text, urls
from siteweave.operators import crawl, products, scoring
from siteweave.plans.registry import CATALOG, query
from siteweave.scratch import folder
from siteweave.sources.tables import catalog, edges, product_edges, table, walk_edges


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("site", F.concat("base", F.lit("/")).alias("url")).distinct()


def _routed(spark: SparkSession, d: str) -> DataFrame:
    return crawl.routed(edges(spark, d))


_ROUTE = "case when milli < 1000 then 'skip' when milli >= 9000 then 'product' else 'queue' end"


@query(f"with {CATALOG} select site, url, milli from edges where milli < 1000")
def band_skip(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).filter("band = 'skip'").select("site", "url", "milli")


@query(f"with {CATALOG} select site, url, milli, product_name from edges where milli >= 9000")
def band_product(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).filter("band = 'product'").select("site", "url", "milli", "product_name")


@query(f"with {CATALOG} select site, url, milli from edges where milli >= 1000 and milli < 9000")
def band_queue(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).filter("band = 'queue'").select("site", "url", "milli")


@query(f"with {CATALOG} select site, parent_url, count(*) filter (milli < 1000) as skipped, count(*) filter (milli >= 9000) as product, count(*) filter (milli >= 1000 and milli < 9000) as queued from edges group by all")
def band_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda band: F.count_if(F.col("band") == band)
    return _routed(spark, d).groupBy("site", "parent_url").agg(n("skip").alias("skipped"), n("product").alias("product"), n("queue").alias("queued"))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The rule verdict: queued products with an odd tens-free key are product pages."""
    rows = catalog(spark, d).filter("partkey % 20 = 1")
    return rows.select("site", F.concat("base", F.lit("/p/"), "partkey").alias("url"), F.col("name").alias("product_name"))


@query(f"with {CATALOG} select site, url, partkey % 20 = 1 and frag = 0 as is_product from pedges where milli >= 8000 and milli < 9000")
def verify_band(spark: SparkSession, d: str) -> DataFrame:
    near = edges(spark, d).filter("milli >= 8000 and milli < 9000").select("site", "url")
    known = _verdicts(spark, d).select("site", "url", F.lit(True).alias("hit"))
    return near.join(known, ["site", "url"], "left").select("site", "url", F.coalesce("hit", F.lit(False)).alias("is_product"))


_MAIN = "regexp_replace(url, '#.*$', '')"
_DEDUP = f"(select site, product_name, url from (select site, title as product_name, url, row_number() over (partition by site, title, {_MAIN} order by contains(url, '#'), url) as k from pedges where milli >= 9000) where k = 1)"


@query(f"with {CATALOG} select site, product_name, url from {_DEDUP}")
def products_from_links(spark: SparkSession, d: str) -> DataFrame:
    return products.dedup(products.from_links(product_edges(spark, d))).select("site", "product_name", "url")


@query(f"with {CATALOG} select site, name as product_name, base || '/p/' || partkey as url, 'verify' as found_by from milli where partkey % 20 = 1")
def products_from_verify(spark: SparkSession, d: str) -> DataFrame:
    return products.from_verdicts(product_edges(spark, d), _verdicts(spark, d))


_ALL_PRODUCTS = "(select site, title as product_name, url from pedges where milli >= 9000 union all select site, name, base || '/p/' || partkey from milli where partkey % 20 = 1)"


@query(f"with {CATALOG} select site, product_name, url from (select *, row_number() over (partition by site, product_name, {_MAIN} order by contains(url, '#'), url) as k from {_ALL_PRODUCTS}) where k = 1")
def dedup_products(spark: SparkSession, d: str) -> DataFrame:
    return products.dedup(_all_products(spark, d)).select("site", "product_name", "url")


def _all_products(spark: SparkSession, d: str) -> DataFrame:
    e = product_edges(spark, d)
    return products.from_links(e).unionByName(products.from_verdicts(e, _verdicts(spark, d)))


@query(f"with {CATALOG} select site, count(*) as n_before, count(distinct (product_name, {_MAIN})) as n_after, count(*) - count(distinct (product_name, {_MAIN})) as removed from {_ALL_PRODUCTS} group by site")
def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    found = _all_products(spark, d)
    before, after = found.groupBy("site").agg(F.count("*").alias("n_before")), products.dedup(found).groupBy("site").agg(F.count("*").alias("n_after"))
    return before.join(after, "site").withColumn("removed", F.col("n_before") - F.col("n_after"))


@query(f"with {CATALOG} select site, row_number() over (partition by site order by url) as number, product_name, url from {_DEDUP}")
def product_numbering(spark: SparkSession, d: str) -> DataFrame:
    rows = products_from_links(spark, d)
    return rows.select("site", F.row_number().over(Window.partitionBy("site").orderBy("url")).alias("number"), "product_name", "url")


# -- scores ---------------------------------------------------------------------------------------------------------


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("parent_url").orderBy("pos")
    return product_edges(spark, d).select("site", "parent_url", "url", "milli", (F.row_number().over(w) - 1).alias("id"))


_NUMBERED = "numbered as (select *, row_number() over (partition by parent_url order by pos) - 1 as id, count(*) over (partition by parent_url) as n from pedges)"


@query(f"with {CATALOG}, {_NUMBERED} select site, url, case when id % 5 = 4 then 0.0 else milli / 1000.0 end::double as score, case when id % 5 = 4 then 'default' else 'id' end as score_source from numbered")
def score_join(spark: SparkSession, d: str) -> DataFrame:
    links = _numbered(spark, d)
    kept = links.filter("id % 5 <> 4").select("parent_url", F.lit(None).cast("int").alias("place"), "id", (F.col("milli") / 1000).alias("score"), F.lit(None).cast("string").alias("product_name"))
    return scoring.join_scores(links, kept, "parent_url").select("site", "url", "score", "score_source")


@query(f"with {CATALOG}, {_NUMBERED} select site, url, case when id = n - 1 then 0.0 else milli / 1000.0 end::double as score, case when id = n - 1 then 'default' when id % 3 = 0 then 'position' else 'id' end as score_source from numbered")
def score_fallback(spark: SparkSession, d: str) -> DataFrame:
    links = _numbered(spark, d)
    last = links.groupBy("parent_url").agg(F.max("id").alias("last"))
    listed = links.join(last, "parent_url").filter("id < last").select("parent_url", F.col("id").alias("place"), F.expr("case when id % 3 <> 0 then id end").alias("id"), (F.col("milli") / 1000).alias("score"), F.lit(None).cast("string").alias("product_name"))
    return scoring.join_scores(links, listed, "parent_url").select("site", "url", "score", "score_source")


# -- nodes ----------------------------------------------------------------------------------------------------------


@query(f"""with {CATALOG} select site, url, parent_url from (
  select site, base || '/' as url, null::varchar as parent_url from pairs group by all union select site, url, parent_url from wedges
  union select site, {_MAIN}, parent_url from pedges)""")
def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    path = urls.tree_path(F.col("url")).alias("path")
    roots = _roots(spark, d).select("site", "url", F.lit("").alias("path"), F.lit(None).cast("string").alias("parent_url"))
    have = roots.unionByName(walk_edges(spark, d).select("site", "url", path, "parent_url"))
    found = product_edges(spark, d).withColumn("url", urls.without_fragment(F.col("url"))).select("site", "url", path, "parent_url")
    again = walk_edges(spark, d).select("site", "url", path, F.lit("https://elsewhere.test/").alias("parent_url"))
    return crawl.upsert(have, found.unionByName(again)).select("site", "url", "parent_url")


@query(f"with {CATALOG} select site, url, parent_url, (case when r = -1 then milli when bn % 2 = 0 then milli + 100 else milli end / 1000.0)::double as score from wedges union all select site, base || '/extra', base || '/', 5.0 from pairs group by all")
def node_upsert_scored(spark: SparkSession, d: str) -> DataFrame:
    have = walk_edges(spark, d).select("site", "url", "parent_url", (F.col("milli") / 1000).alias("score"))
    again = have.filter("url rlike '/b/[0-9]*[02468]/[0-9]+$'").select("site", "url", F.lit("x").alias("parent_url"), ((F.round(F.col("score") * 1000) + 100) / 1000).alias("score"))
    extra = _roots(spark, d).select("site", F.concat("url", F.lit("extra")).alias("url"), F.col("url").alias("parent_url"), F.lit(5.0).alias("score"))
    return crawl.upsert_scored(have, again.unionByName(extra))


@query(f"with {CATALOG} select site, parent_url, count(*) as total_children, count(*) filter (milli < 1000 or milli >= 9000) as explored_children from edges group by all")
def children_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _routed(spark, d).withColumn("is_explored", F.col("band") != "queue")
    return rows.groupBy("site", "parent_url").agg(F.count("*").alias("total_children"), F.count_if("is_explored").alias("explored_children"))


@query(f"with {CATALOG} select site, url, round((7999 - 20 * bn + 4000 + 50 * bn + 7 * r + milli) / 3000.0, 6)::double as avg_score from pedges")
def ancestor_avg(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).select("site", "parent_url", "url", (F.col("milli") / 1000).alias("score"))
    up = lambda rows: rows.join(e.select("site", F.col("url").alias("at"), F.col("parent_url").alias("next"), F.col("score").alias("s")), ["site", "at"], "left")
    rows = e.filter(F.col("url").contains("/p/")).select("site", "url", F.col("parent_url").alias("at"), F.array("score").alias("path_scores"))
    for _ in range(3):  # depth of the graph
        rows = up(rows).select("site", "url", F.col("next").alias("at"), F.concat("path_scores", F.array(F.coalesce("s", F.lit(0.0)))).alias("path_scores"))
    return rows.select("site", "url", F.round(crawl.average(F.col("path_scores")), 6).alias("avg_score"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).withColumn("url", urls.without_fragment(F.col("url")))
    return crawl.bfs(e, _roots(spark, d))


_LEVELS = f"""levels as (
  select site, base || '/' as url, 0 as level, -1 as bn, -1 as r, 0 as partkey from pairs group by all
  union all select site, url, case when r = -1 then 1 else 2 end, bn, r, 0 from wedges
  union all select distinct site, {_MAIN}, 3, bn, r, partkey from pedges)"""


@query(f"with {CATALOG}, {_LEVELS} select site, url, level, row_number() over (partition by site, level order by bn, r, partkey)::int as rank from levels")
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("site", "url", "level", "rank")


@query(f"with {CATALOG}, {_LEVELS} select site, url, visit from (select site, url, row_number() over (partition by site order by level, bn, r, partkey)::int as visit from levels) where visit <= 20")
def bfs_max_pages(spark: SparkSession, d: str) -> DataFrame:
    return crawl.within_budget(_levels(spark, d), 20).select("site", "url", "visit")


@query(f"with {CATALOG}, {_LEVELS} select site, max(level) as max_depth, count(*) as nodes from levels group by site")
def tree_depth(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).groupBy("site").agg(F.max("level").alias("max_depth"), F.count("*").alias("nodes"))


@query(f"with {CATALOG}, {_LEVELS}, v as (select *, row_number() over (partition by site order by level, bn, r, partkey) as k from levels) select site, url, case when k <= 20 then '✓' else '○' end as status from v where level > 0")
def link_status(spark: SparkSession, d: str) -> DataFrame:
    levels = _levels(spark, d)
    visited = crawl.within_budget(levels, 20).select("site", "url", F.lit("✓").alias("mark"))
    return levels.filter("level > 0").join(visited, ["site", "url"], "left").select("site", "url", F.coalesce("mark", F.lit("○")).alias("status"))


# -- best first -----------------------------------------------------------------------------------------------------

BUDGET = 12
_WALK = """walk as (
  select site, base || '/' as url, null::varchar as parent_url, 0 as bn, -2 as r, 100.0 as a, 0.0 as avg_score from pairs group by all
  union all select site, url, parent_url, bn, r, milli / 1000.0, milli / 1000.0 from wedges where r = -1
  union all select site, url, parent_url, bn, r, (milli + 7999 - 20 * bn) / 2000.0, (milli + 7999 - 20 * bn) / 2000.0 from wedges where r >= 0),
popped as (select *, (row_number() over (partition by site order by a desc) - 1)::int as pop_seq from walk)"""


def _walked(spark: SparkSession, d: str) -> DataFrame:
    return crawl.best_first(walk_edges(spark, d), _roots(spark, d), BUDGET)


@query(f"with {CATALOG}, {_WALK} select site, url, parent_url, pop_seq, round(avg_score, 6)::double as avg_score from popped where pop_seq < {BUDGET}")
def best_first_crawl(spark: SparkSession, d: str) -> DataFrame:
    return _walked(spark, d).filter("pop_seq is not null").select("site", "url", "parent_url", "pop_seq", F.round("avg_score", 6).alias("avg_score"))


#: Pages of a guided crawl.
GUIDED = 30


@query(f"""with {CATALOG}, nodes as (
  select site, base || '/' as url, 100.0::double as a, 0 as bn, -2 as r, 0 as leaf, 0 as m, 0 as pos, false as hit, null::varchar as name from pairs group by all
  union all select site, url, milli / 1000.0, bn, r, 0, 0, 0, false, null from wedges where r = -1
  union all select site, url, (milli + 7999 - 20 * bn) / 2000.0, bn, r, 0, 0, 0, false, null from wedges where r >= 0
  union all select site, url, (11999 + 30 * bn + 7 * r) / 2000.0, bn, r, 1, milli, pos, partkey % 20 = 1 and frag = 0, title from pedges where milli >= 1000 and milli < 9000),
seen as (select *, (row_number() over w - 1)::int as pop_seq, coalesce(sum(case when hit then 0 else 1 end) over (w rows between unbounded preceding and 1 preceding), 0) as used
  from nodes window w as (partition by site order by a desc, bn, r, leaf, m desc, pos)),
popped as (select * from seen where used < {GUIDED})
select site, url, pop_seq, case when hit then 'verify' end as found_by, case when hit then name end as product_name from popped
union all select e.site, e.url, null, 'link', e.product_name from pedges e join popped p on p.site = e.site and p.url = e.parent_url where e.milli >= 9000""")
def guided_crawl(spark: SparkSession, d: str) -> DataFrame:
    """The whole guided crawl over the catalogue: bands, best-first order, verification of popped pages, products of links."""
    nodes = crawl.best_first(edges(spark, d), _roots(spark, d), GUIDED, _verdicts(spark, d))
    return nodes.filter("pop_seq is not null or found_by is not null").select("site", "url", "pop_seq", "found_by", "product_name")


@query("""select page_id, url, case when regexp_matches(lower(p), '/(?:p|product|products|item|items|dp)/[^/?]+') then 9200 when regexp_matches(lower(p), '/(?:b|c|category|categories|collection|collections|shop|catalog|brand|brands)(?:/|$)') then 7000
  when regexp_matches(lower(p), '/(?:login|account|cart|checkout|privacy|terms|imprint|contact|about|help|jobs)(?:/|$)') then 500 else 4000 end as milli,
  case when regexp_matches(lower(p), '/(?:p|product|products|item|items|dp)/[^/?]+') then 'Part ' || page_id end as product_name
from (select p_partkey as page_id, case p_partkey % 6 when 0 then '/p/' || p_partkey when 1 then '/Shop' when 2 then '/about/us' when 3 then '/products/' when 4 then '/x?p=/p/1' else '/brand/b' end as u,
  'https://s.test' || u as url, regexp_extract(u, '^[^?#]*') as p from part)""")
def score_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    path = F.when(k == 0, F.concat(F.lit("/p/"), "p_partkey")).when(k == 1, "/Shop").when(k == 2, "/about/us").when(k == 3, "/products/").when(k == 4, "/x?p=/p/1").otherwise("/brand/b")
    links = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://s.test"), path).alias("url"), F.concat(F.lit("Part "), "p_partkey").alias("title"))
    return scoring.rules(links).select("page_id", "url", "milli", "product_name")


@query(f"""with {CATALOG}, {_WALK} select p.site, 'https://' || p.site || '/' as base_url, p.site as domain, count(*) filter (pop_seq < {BUDGET}) as pages_processed,
  count(*) filter (r = -2 or r = -1 or parent_url in (select url from popped b where b.site = p.site and b.pop_seq < {BUDGET})) as total_nodes
from popped p group by p.site""")
def crawl_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _walked(spark, d).groupBy("site").agg(F.count_if("is_explored").alias("pages_processed"), F.count("*").alias("total_nodes"))
    base = F.concat(F.lit("https://"), "site", F.lit("/"))
    return rows.select("site", base.alias("base_url"), urls.domain(base).alias("domain"), "pages_processed", "total_nodes")


def _frontier(spark: SparkSession, d: str) -> DataFrame:
    """The queue after every page was met: averages, and insertion order by parent and position."""
    e = walk_edges(spark, d).select("site", "parent_url", "url", "pos", (F.col("milli") / 1000).alias("score"))
    above = e.select("site", F.col("url").alias("parent_url"), F.col("score").alias("s"))
    avg = crawl.average(F.array(F.col("score"), F.coalesce("s", F.lit(0.0))))
    return e.join(above, ["site", "parent_url"], "left").select("site", "url", "parent_url", F.round(avg, 6).alias("avg_score"), F.row_number().over(Window.partitionBy("site").orderBy("parent_url", "pos")).alias("insert_seq"))


@query(f"with {CATALOG}, {_WALK} select site, url, round(avg_score, 6)::double as avg_score, (row_number() over (partition by site order by a desc))::int as place from walk where r > -2")
def frontier_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("site").orderBy(F.desc("avg_score"), "insert_seq")
    return _frontier(spark, d).select("site", "url", "avg_score", F.row_number().over(w).alias("place"))


@query(f"with {CATALOG}, {_WALK} select site, url, round(avg_score, 6)::double as avg_score from walk where r > -2 order by round(avg_score, 6) desc, url limit 10")
def frontier_top(spark: SparkSession, d: str) -> DataFrame:
    return _frontier(spark, d).select("site", "url", "avg_score").orderBy(F.desc("avg_score"), "url").limit(10)


@query(f"with {CATALOG} select site, count(*) as queued from edges where milli >= 1000 and milli < 9000 group by site")
def frontier_size(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).filter("band = 'queue'").groupBy("site").agg(F.count("*").alias("queued"))


@query(f"""with {CATALOG}, {_NUMBERED}, fresh as (select * from numbered where partkey % 11 <> 0)
select site, parent_url, url, {_ROUTE} as band, milli >= 9000 as emitted, case when milli >= 1000 and milli < 9000 then round((milli + 4000 + 50 * bn + 7 * r) / 2000.0, 6) end::double as priority from fresh""")
def expand_step(spark: SparkSession, d: str) -> DataFrame:
    links = product_edges(spark, d)
    known = catalog(spark, d).filter("partkey % 11 = 0")
    known = known.select("site", F.concat("base", F.lit("/p/"), "partkey").alias("main")).distinct()
    fresh = links.withColumn("main", urls.without_fragment(F.col("url"))).join(known, ["site", "main"], "left_anti")
    parents = walk_edges(spark, d).select("site", F.col("url").alias("parent_url"), (F.col("milli") / 1000).alias("above"))
    rows = crawl.routed(fresh).join(parents, ["site", "parent_url"])
    priority = F.when(F.col("band") == "queue", F.round(crawl.average(F.array("score", "above")), 6))
    return rows.select("site", "parent_url", "url", "band", (F.col("band") == "product").alias("emitted"), priority.alias("priority"))


# -- reports --------------------------------------------------------------------------------------------------------


def _tree(spark: SparkSession, d: str) -> DataFrame:
    w = walk_edges(spark, d).select("site", "url", urls.tree_path(F.col("url")).alias("path"), "parent_url", (F.col("pos") % 2 == 0).alias("is_explored"))
    return _roots(spark, d).select("site", "url", F.lit("").alias("path"), F.lit(None).cast("string").alias("parent_url"), F.lit(True).alias("is_explored")).unionByName(w)


@query(f"""with {CATALOG}, n as (
  select site, replace(url, 'https://' || site, '') as path, parent_url, url, pos % 2 = 0 as ex, r,
    lead(url) over (partition by site, parent_url order by replace(url, 'https://' || site, '')) is null as is_last from wedges),
c as (select site, parent_url, count(*) as t, count(*) filter (ex) as e from n group by all),
b as (select n.*, coalesce(c.t, 0) as t, coalesce(c.e, 0) as e from n left join c on c.site = n.site and c.parent_url = n.url),
lines as (
  select site, [] ::varchar[] as key, '└── ✓ (root) [' || e || '/' || t || ' explored]' as line from c where parent_url = 'https://' || site || '/'
  union all select site, [path], '    ' || case when is_last then '└── ' else '├── ' end || case when ex then '✓' else '○' end || ' ' || path || ' [' || e || '/' || t || ' explored]' from b where r = -1
  union all select b.site, [p.path, b.path], '    ' || case when p.is_last then '    ' else '│   ' end || case when b.is_last then '└── ' else '├── ' end || case when b.ex then '✓' else '○' end || ' ' || b.path || ' [0/0 explored]'
    from b join b p on p.site = b.site and p.url = b.parent_url where b.r >= 0)
select site, row_number() over (partition by site order by key)::int as line_no, line from lines""")
def tree_report(spark: SparkSession, d: str) -> DataFrame:
    return crawl.tree_lines(_tree(spark, d))


_JSON = f"""json as (select site, list({{'productName': product_name, 'url': url}} order by url) as products, count(*) as n from {_DEDUP} group by site)"""


@query(f"with {CATALOG}, {_JSON} select site, to_json({{'products': products, 'base_url': 'https://' || site || '/', 'domain': site}})::varchar as body from json")
def results_json(spark: SparkSession, d: str) -> DataFrame:
    from siteweave.sources.sinks import result_rows

    rows = result_rows(products_from_links(spark, d))
    return rows.select("site", F.to_json(F.struct("products", "base_url", "domain")).alias("body"))


@query(f"with {CATALOG} select site, product_name, url from {_DEDUP}")
def results_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from siteweave.sources.sinks import read_results, result_rows, write_results

    path = folder(spark)
    write_results(result_rows(products_from_links(spark, d)), path)
    return read_results(spark, path).select("site", "product_name", "url")


@query(f"with {CATALOG} select site, parent_url, list({{'id': k, 'relative_path': replace(url, 'https://' || site, ''), 'title': title, 'description': ''}} order by k)::json::varchar as payload from (select *, (row_number() over (partition by parent_url order by pos) - 1)::int as k from wedges) group by all")
def prompt_payload(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("parent_url").orderBy("pos")
    rows = walk_edges(spark, d).withColumn("id", (F.row_number().over(w) - 1).cast("int"))
    item = F.struct("id", urls.relative_path(F.col("url")).alias("relative_path"), text.strip(F.col("title")).alias("title"), F.lit("").alias("description"))
    return rows.groupBy("site", "parent_url").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("payload"))
