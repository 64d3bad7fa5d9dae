"""Queries over recorded page states: snapshots of the catalogue, twenty products a step, and scroll positions made from suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteweave.functions import urls
from siteweave.operators import dynamic
from siteweave.plans.registry import CATALOG, query
from siteweave.sources.tables import catalog, table

#: Products a step; sites with a supplier key of 1 modulo 3 repeat step 3 at step 4 and go on after it.
PER_STEP = 20


def _steps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("site").orderBy("partkey")
    rows = catalog(spark, d).withColumn("step", (F.floor((F.row_number().over(w) - 1) / PER_STEP) + 1).cast("int"))
    gap = F.regexp_extract("site", "([0-9]+)", 1).cast("int") % 3 == 1
    return rows.withColumn("step", F.explode(F.when(gap & (F.col("step") == 3), F.array(F.lit(3), F.lit(4))).when(gap & (F.col("step") > 3), F.array(F.col("step") + 1)).otherwise(F.array("step"))))


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """page_snapshots(url, trigger_id, step, html): triggers 1 and 2 of each site show the same steps, 3 shows one step of its own."""
    anchor = F.concat(F.lit('<a href="/p/'), F.lpad(F.col("partkey").cast("string"), 9, "0"), F.lit('">x</a>'))
    pages = _steps(spark, d).groupBy(F.concat("base", F.lit("/")).alias("url"), "step").agg(F.array_join(F.sort_array(F.collect_list(anchor)), "").alias("html"))
    both = pages.withColumn("trigger_id", F.explode(F.lit([1, 2])))
    sites = pages.select("url").distinct()
    tab = sites.select("url", F.lit(3).alias("trigger_id"), F.explode(F.lit([1, 2])).alias("step")).withColumn("html", F.concat(F.lit('<a href="/tab/'), "step", F.lit('">t</a><a href="#x">no</a>')))
    start = sites.select("url", F.explode(F.lit([1, 2, 3])).alias("trigger_id"), F.lit(0).alias("step"), F.lit('<a href="/home">h</a>').alias("html"))
    return both.select("url", "trigger_id", "step", "html").union(tab.select("url", "trigger_id", "step", "html")).union(start)


def _triggers(spark: SparkSession, d: str) -> DataFrame:
    sites = catalog(spark, d).select(F.concat("base", F.lit("/")).alias("page_url")).distinct()
    kinds = F.create_map(F.lit(1), F.lit("Pagination"), F.lit(2), F.lit("Load More"), F.lit(3), F.lit("Tabs"), F.lit(4), F.lit("Hover"))
    return sites.select("page_url", F.explode(kinds).alias("trigger_id", "trigger_type"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Products with a key divisible by 13 were found before."""
    rows = catalog(spark, d).filter("partkey % 13 = 0")
    return rows.select(F.concat("base", F.lit("/")).alias("page_url"), F.concat("base", F.lit("/p/"), F.lpad(F.col("partkey").cast("string"), 9, "0")).alias("url"))


_STEPS = f"""{CATALOG}, numbered as (select *, ((row_number() over (partition by site order by partkey) - 1) // {PER_STEP} + 1)::int as s from cat),
steps as (
  select site, base, suppkey, partkey, base || '/p/' || lpad(partkey::varchar, 9, '0') as url, case when suppkey % 3 = 1 and s > 3 then s + 1 else s end as step from numbered
  union all select site, base, suppkey, partkey, base || '/p/' || lpad(partkey::varchar, 9, '0'), 4 from numbered where suppkey % 3 = 1 and s = 3),
fresh as (select base || '/' as page_url, url, min(step) as step from steps where partkey % 13 <> 0 group by all),
lasts as (select page_url, min(step) as gap from (
    select page_url, unnest(range(1, (select max(step) + 2 from fresh)))::int as step from (select distinct page_url from fresh)
    except select page_url, step from fresh) group by page_url)"""


def _sql_exhaust(limit: int) -> str:
    return f"with {_STEPS} select page_url, step, url from fresh join lasts using (page_url) where step < gap and step <= {limit}"


def _one(spark: SparkSession, d: str, trigger: int) -> DataFrame:
    links = dynamic.snapshot_links(_snapshots(spark, d).filter(F.col("trigger_id") == trigger))
    return dynamic.exhausted(links, _triggers(spark, d), _known(spark, d)).select("page_url", "step", "url")


@query(f"with {_STEPS}, c as (select base || '/' as url, step, count(*) as n from steps group by all) select url, trigger_id, step, n as n_links from c, (values (1), (2)) t(trigger_id) union all select url, 3, s, 2 from (select distinct url from c), (values (1), (2)) x(s) union all select url, t, 0, 1 from (select distinct url from c), (values (1), (2), (3)) x(t)")
def snapshot_scan(spark: SparkSession, d: str) -> DataFrame:
    pages = _triggers(spark, d).select("page_url").distinct()
    rows = _snapshots(spark, d).join(pages, F.col("url") == F.col("page_url"))
    return rows.select("url", "trigger_id", "step", F.regexp_count("html", F.lit("<a href=")).cast("long").alias("n_links"))


@query(_sql_exhaust(10))
def exhaust_pagination(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, 1)


@query(_sql_exhaust(20))
def exhaust_load_more(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, 2)


@query(f"with {_STEPS} select distinct base || '/' as page_url, 1 as step, base || '/tab/1' as url from steps")
def exhaust_single_click(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, 3)


@query(f"""with {_STEPS}, p as (select page_url, 1 as trigger_id, step, url from fresh join lasts using (page_url) where step < gap and step <= 10),
rest as (select f.* from fresh f where not exists (select 1 from p where p.page_url = f.page_url and p.url = f.url)),
l as (select page_url, 2 as trigger_id, step, url from rest r where step <= 20 and not exists (
  select 1 from (select unnest(range(1, r.step)) as k) x where not exists (select 1 from rest q where q.page_url = r.page_url and q.step = x.k)))
select page_url, trigger_id, step, url from p union all select page_url, trigger_id, step, url from l union all select distinct base || '/', 3, 1, base || '/tab/1' from steps""")
def dynamic_links(spark: SparkSession, d: str) -> DataFrame:
    return dynamic.session(dynamic.snapshot_links(_snapshots(spark, d)), _triggers(spark, d), _known(spark, d))


@query("""select p_partkey as page_id, id, text_content, trigger_type from part, (values (0, 'more'), (1, 'next')) e(id, text_content), (values (1, 'Pagination'), (5, 'Tabs')) t(tid, trigger_type) where id = tid""")
def trigger_join(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"))
    elements = pages.select("page_id", F.explode(F.create_map(F.lit(0), F.lit("more"), F.lit(1), F.lit("next"))).alias("id", "text_content"))
    triggers = pages.select("page_id", F.explode(F.create_map(F.lit(1), F.lit("Pagination"), F.lit(5), F.lit("Tabs"))).alias("id", "trigger_type"))
    return elements.join(triggers, ["page_id", "id"]).select("page_id", "id", "text_content", "trigger_type")


@query(f"with {CATALOG} select distinct base || '/' as page_url, trigger_id, trigger_type, step_limit from cat, (values (1, 'Pagination', 10), (2, 'Load More', 20), (3, 'Tabs', 1)) t(trigger_id, trigger_type, step_limit)")
def trigger_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return dynamic.dispatched(_triggers(spark, d))


@query("""select p_partkey as page_id, 0 as id, case p_partkey % 5 when 0 then 10 when 1 then 11 when 2 then 12 when 3 then 13 end as element, (p_partkey % 5)::int as rule from part where p_partkey % 5 < 4""")
def element_resolve(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pages = table(spark, d, "part").select(k.alias("page_id"))
    m = F.col("page_id") % 5
    targets = pages.select(
        "page_id",
        F.lit(0).alias("id"),
        F.lit("button").alias("tag_name"),
        F.when(m == 1, "more").otherwise("").alias("text_content"),
        F.when(m == 2, "big red").otherwise("").alias("class_names"),
        F.when(m == 0, "b1").otherwise("").alias("element_id"),
        F.when(m == 3, "Next").when(m == 4, "gone").otherwise("").alias("aria_label"),
    )
    fixed = [(10, "a", "", "", "b1", ""), (11, "button", "Load more now", "", "", ""), (12, "button", "", "small big", "", ""), (13, "i", "", "", "", "Next"), (14, "a", "more", "big", "", "")]
    names = ("element", "tag_name", "text_content", "class_names", "element_id", "aria_label")
    elements = pages.withColumn("e", F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(row, names, strict=True))) for row in fixed)))).select("page_id", "e.*")
    return dynamic.resolved_elements(targets, elements)


# -- scrolling ------------------------------------------------------------------------------------------------------


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """Per supplier a container of steps 0 to 12: links grow unless (key + step) % 4 is below key % 4; heights end at step key % 12."""
    k, s = F.col("s_suppkey"), F.col("step")
    rows = table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("step"))
    grows = F.when((k + s) % 4 >= k % 4, 1).otherwise(0)
    grown = F.sum(grows).over(Window.partitionBy("s_suppkey").orderBy("step"))
    flat = F.lit(7).cast("long")
    return rows.select(
        "s_suppkey",
        "step",
        (20 + grown).alias("link_count"),
        flat.alias("product_count"),
        flat.alias("card_count"),
        flat.alias("list_item_count"),
        (s * 100).alias("scroll_top"),
        F.lit(400).alias("client_height"),
        (F.greatest(s, (k % 12).cast("int")) * 100 + 405).alias("scroll_height"),
    )


_POS = """pos as (select s_suppkey, step, 20 + sum(case when (s_suppkey + step) % 4 >= s_suppkey % 4 then 1 else 0 end) over (partition by s_suppkey order by step) as link_count,
  step * 100 as top, greatest(step, s_suppkey % 12) * 100 + 405 as height from supplier, (select unnest(range(0, 13))::int as step)),
ch as (select *, coalesce(link_count > lag(link_count) over (partition by s_suppkey order by step), false) as grew, top + 400 >= height - 10 as bottom from pos),
runs as (select *, step - coalesce(max(case when grew or step = 0 then step end) over (partition by s_suppkey order by step), 0) as still from ch),
ends as (select s_suppkey, min(step) as last_step from runs where step > 0 and (still >= 3 or (bottom and still > 0) or step = 10) group by s_suppkey)"""


@query(f"with {_POS} select s_suppkey, last_step as scrolls, coalesce(list_sort(list(step) filter (grew and step > 0 and step <= last_step)), []::int[]) as growths from ends join runs using (s_suppkey) group by s_suppkey, last_step")
def exhaust_scroll(spark: SparkSession, d: str) -> DataFrame:
    return dynamic.scrolled(_positions(spark, d), "s_suppkey")


@query(f"with {_POS} select s_suppkey, step, grew from ch where step > 0")
def content_changed(spark: SparkSession, d: str) -> DataFrame:
    m = F.struct(*dynamic.GROWING)
    old = F.lag(m).over(Window.partitionBy("s_suppkey").orderBy("step"))
    rows = _positions(spark, d).select("s_suppkey", "step", m.alias("new"), old.alias("old")).filter("old is not null")
    return rows.select("s_suppkey", "step", dynamic.changed(F.col("new"), F.col("old")).alias("grew"))


@query(f"with {_POS} select s_suppkey, step, bottom from ch")
def scroll_at_bottom(spark: SparkSession, d: str) -> DataFrame:
    at = dynamic.at_bottom(F.col("scroll_top"), F.col("client_height"), F.col("scroll_height"))
    return _positions(spark, d).select("s_suppkey", "step", at.alias("bottom"))


@query("select s_suppkey, (s_suppkey % 3 < 2 and s_suppkey % 7 > 2) as scrollable from supplier")
def scroll_containers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    overflow: Column = F.element_at(F.lit(["auto", "scroll", "hidden"]), (k % 3 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", dynamic.scrollable(overflow, F.lit(200), ((k % 7) * 100).cast("int")).alias("scrollable"))


@query("""select site, rank, links, spent from (select s_suppkey % 20 as site, (s_suppkey // 20)::int as rank, (s_suppkey * 7 % 6)::int as links,
  coalesce(sum(greatest(s_suppkey * 7 % 6, 1)) over (partition by s_suppkey % 20 order by s_suppkey // 20 rows between unbounded preceding and 1 preceding), 0)::bigint as spent from supplier) where spent < 15""")
def scroll_budget(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select((k % 20).alias("site"), F.floor(k / 20).cast("int").alias("rank"), (k * 7 % 6).cast("int").alias("links"))
    return dynamic.budgeted(rows, "site")


@query(f"""with {_STEPS} select base || '/' as page_url, url from steps where step = 1 and suppkey % 2 = 0 and partkey % 13 <> 0""")
def exhaust_trigger_zone(spark: SparkSession, d: str) -> DataFrame:
    """One scroll to a zone, tried where containers gave nothing (here: even suppliers); links count if the content grew."""
    snapshots = _snapshots(spark, d).filter("trigger_id = 1 and step <= 1")
    tried = snapshots.filter(F.regexp_extract("url", "([0-9]+)", 1).cast("int") % 2 == 0)
    n = F.regexp_count("html", F.lit("<a href="))
    grown = tried.groupBy(F.col("url").alias("page_url")).agg(F.max(F.when(F.col("step") == 1, n)).alias("after"), F.max(F.when(F.col("step") == 0, n)).alias("before")).filter("after > before")
    links = dynamic.snapshot_links(tried.filter("step = 1")).join(grown.select("page_url"), "page_url")
    return links.join(_known(spark, d), ["page_url", "url"], "left_anti").filter(urls.same_domain(F.col("url"), F.col("page_url"))).select("page_url", "url")
