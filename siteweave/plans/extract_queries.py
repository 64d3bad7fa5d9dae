"""Queries over page HTML: the regular fast path on driver pages, the DOM path on pages generated from the part table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteweave.functions import dom, text, urls
from siteweave.operators import html
from siteweave.plans.registry import HREFS, query, sql_domain, sql_relative
from siteweave.sources.tables import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return html.anchors(_pages(spark, d))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return html.resolved(_anchors(spark, d))


def _firsts(spark: SparkSession, d: str) -> DataFrame:
    return html.first_in_page(_links(spark, d))


# -- fast path ------------------------------------------------------------------------------------------------------


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s]+|[\\s]+$', '', 'g')"


def _sql_unescape(x: str) -> str:
    for name, char in text.ENTITIES:
        x = f"replace({x}, '{name.replace(chr(39), chr(39) * 2)}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


_VISIBLE = lambda x: _sql_strip(_sql_unescape(f"regexp_replace({x}, '<[^>]*>', '', 'g')"))
_TITLE = _sql_strip(_sql_unescape("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))
_DESCRIPTION = _VISIBLE("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")
_BARE = "regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g')"
_FLAT = _sql_unescape(f"regexp_replace({_BARE}, '<[^>]*>', '', 'g')")
_CLEAN = f"array_to_string(list_filter(list_transform(regexp_split_to_array({_FLAT}, '[\\n\\r]+|  '), lambda x: {_sql_strip('x')}), lambda x: x <> ''), ' ')"


@query(f"with {HREFS} select page_id, pos, href from hrefs")
def extract_anchors(spark: SparkSession, d: str) -> DataFrame:
    return _anchors(spark, d).select("page_id", "pos", "href")


@query(f"select page_id, {_TITLE} as title from pages")
def page_title(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", text.title(F.col("html")).alias("title"))


@query(f"select page_id, {_DESCRIPTION} as description from pages")
def page_description(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", text.description(F.col("html")).alias("description"))


@query(f"select page_id, case when length(c) > 3000 then substr(c, 1, 3000) || '...' else c end as page_text from (select page_id, {_CLEAN} as c from pages)")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", text.page_text(F.col("html")).alias("page_text"))


_CONTENT = f"select page_id, url, title, description, case when length(c) > 3000 then substr(c, 1, 3000) || '...' else c end as text_content from (select page_id, url, {_TITLE} as title, {_DESCRIPTION} as description, {_CLEAN} as c from pages)"


@query(_CONTENT)
def page_content(spark: SparkSession, d: str) -> DataFrame:
    return html.page_content(_pages(spark, d))


@query(_CONTENT)
def page_content_dom(spark: SparkSession, d: str) -> DataFrame:
    return html.dom_content(_pages(spark, d), text.ENTITIES)


@query(f"select page_id, length(title) as title_chars, length(text_content) as text_chars from ({_CONTENT}) where title <> '' or text_content <> ''")
def content_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = html.page_content(_pages(spark, d)).filter("title <> '' or text_content <> ''")
    return rows.select("page_id", F.length("title").cast("long").alias("title_chars"), F.length("text_content").cast("long").alias("text_chars"))


@query("select page_id, " + ", ".join(f"len(regexp_extract_all(bare, '{p}')) as {name}" for name, p in text.METRICS.items()) + " from (select page_id, regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<!--.*?-->', '<script>', 'g') as bare from pages)")
def content_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", *(c.alias(n) for n, c in text.metrics(F.col("html")).items()))


@query(f"with {HREFS} select distinct page_id, regexp_extract(url, '^[^/]+//[^/?#]*') || {sql_relative('url')} as url from links where {sql_domain('url')} = site")
def bfs_links(spark: SparkSession, d: str) -> DataFrame:
    rows = _anchors(spark, d).filter(urls.link_scheme_ok(F.col("href"))).withColumn("url", urls.normalize(F.col("page_url"), F.col("href")))
    return rows.filter((urls.domain(F.col("url")) == F.col("site")) | (urls.domain(F.col("url")) == "")).select("page_id", "url").distinct()


@query(f"with {HREFS} select page_id, pos, url from firsts")
def dedup_in_page(spark: SparkSession, d: str) -> DataFrame:
    return _firsts(spark, d).select("page_id", "pos", "url")


@query(f"with {HREFS} select page_id, url from firsts where starts_with(page_url, 'https') and regexp_replace(url, '^https', 'http') not in (select url from firsts where not starts_with(page_url, 'https'))")
def anti_discovered(spark: SparkSession, d: str) -> DataFrame:
    """Links of https pages that weren't discovered by way of http before."""
    rows = _firsts(spark, d).select("page_id", "page_url", "url")
    secure = F.col("page_url").startswith("https")
    known = rows.filter(~secure).select(F.col("url").alias("plain")).distinct()
    return rows.filter(secure).withColumn("plain", F.regexp_replace("url", "^https", "http")).join(known, "plain", "left_anti").select("page_id", "url")


@query(f"with {HREFS} select site, page_id, url from (select *, row_number() over (partition by site, url order by page_id, pos) as k from links) where k = 1")
def session_dedup(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("site", "url").orderBy("page_id", "pos")
    return _links(spark, d).withColumn("k", F.row_number().over(w)).filter("k = 1").select("site", "page_id", "url")


@query(f"with {HREFS} select distinct site, url from links")
def union_links(spark: SparkSession, d: str) -> DataFrame:
    rows = _links(spark, d).select("site", "url", F.col("page_url").startswith("https").alias("secure"))
    return rows.filter("secure").drop("secure").union(rows.filter("not secure").drop("secure")).distinct()


@query(f"with {HREFS} select page_id, url, (row_number() over (partition by page_id order by pos % 2, pos) - 1)::int as link_id, case when pos % 2 = 0 then 'static' else 'dynamic' end as source from firsts")
def union_all_links(spark: SparkSession, d: str) -> DataFrame:
    rows = _firsts(spark, d).select("page_id", "url", "pos")
    both = rows.filter("pos % 2 = 0").withColumn("source", F.lit("static")).unionByName(rows.filter("pos % 2 = 1").withColumn("source", F.lit("dynamic")))
    w = Window.partitionBy("page_id").orderBy(F.col("source") != "static", "pos")
    return both.select("page_id", "url", (F.row_number().over(w) - 1).cast("int").alias("link_id"), "source")


@query(f"with {HREFS} select distinct url from links where url not in (select url from links where contains(page_url, '?'))")
def except_visited(spark: SparkSession, d: str) -> DataFrame:
    """Links that no page with a query in its address shows."""
    rows = _links(spark, d).select("url", "page_url")
    return rows.select("url").distinct().join(rows.filter(F.col("page_url").contains("?")).select("url").distinct(), "url", "left_anti")


@query(f"with {HREFS} select site, count(distinct url) as unique_links, count(distinct page_id) as pages_visited from links group by site")
def unique_links(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).groupBy("site").agg(F.count_distinct("url").alias("unique_links"), F.count_distinct("page_id").alias("pages_visited"))


@query(f"with {HREFS} select page_id, url from (select *, row_number() over (partition by page_id order by pos) as k from firsts) where k <= 5")
def top_n_per_page(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("pos")
    return _firsts(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 5").select("page_id", "url")


# -- DOM path -------------------------------------------------------------------------------------------------------

_WIDGETS = (
    '<html><head><title>T{k}</title></head><body><nav id="menu"><a href="/a/{k}">Item {k}</a></nav><map><area href="/area/{k}" alt="Area {k}"></map>'
    '<form action="/f/{k}"{m}>{i}</form><button formaction="/btn/{k}" title=" Buy {k} ">B</button><div data-href="/dh/{k}">H</div><p data-url="/du/{k}">U</p>'
    '<i data-link="/dl/{k}"></i><b data-target="#t">N</b><b data-target="/dt/{k}">T</b><span onclick="location.href(\'/oc/{k}\')">C</span>'
    '<span onclick="window.open(\'/ow/{k}\')" aria-label="Open {k}">O</span><span onclick="location.href=\'/no\'">X</span><a href="/a/{k}">again</a>'
    '<a href="mailto:x@y.z">m</a><a href="MAILTO:q">M</a><a href="//other.test/z">out</a></body></html>'
)
#: What _WIDGETS holds, in order of ids: kind, path or url, title, text, description ('=' is the text of the body).
_EXPECTED = [
    ("anchor", "/a/{k}", "Item {k}", "Item {k}", ""),
    ("anchor", "MAILTO:q", "M", "M", "="),
    ("area", "/area/{k}", "Area {k}", "", ""),
    ("form", "/f/{k}", "Form submission", "", "{f}"),
    ("button", "/btn/{k}", "Buy {k}", "B", "="),
    ("data", "/dh/{k}", "H", "H", "="),
    ("data", "/du/{k}", "U", "U", "="),
    ("data", "/dl/{k}", "", "", "="),
    ("data", "/dt/{k}", "T", "T", "="),
    ("onclick", "/oc/{k}", "C", "C", "="),
    ("onclick", "/ow/{k}", "O", "O", "Open {k}"),
]


def _fill(template: str) -> Column:
    k = F.col("p_partkey")
    fields = F.when(k % 3 == 0, "").otherwise('<input type="text"><select></select><textarea></textarea><input type="x">')
    out = F.lit(template)
    for name, value in (("{m}", F.when(k % 2 == 0, ' method="post"').otherwise("")), ("{i}", fields), ("{k}", k.cast("string"))):
        out = F.replace(out, F.lit(name), value)
    return out


def _widgets(spark: SparkSession, d: str, template: str = _WIDGETS) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("page_id"), F.concat(F.lit("https://shop.test/dir/"), k).alias("url"), _fill(template).alias("html"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_widgets(columns: str, kinds: tuple[str, ...] | None = None) -> str:
    rows = ", ".join(f"({n}, {_q(kind)}, {_q(u if u.startswith('MAILTO') else 'https://shop.test' + u)}, {_q(t)}, {_q(x)}, {_q(y)})" for n, (kind, u, t, x, y) in enumerate(_EXPECTED) if kinds is None or kind in kinds)
    fill = lambda c: f"replace({c}, '{{k}}', p_partkey::varchar)"
    form = "(case when p_partkey % 2 = 0 then 'POST' else 'GET' end || ' form' || case when p_partkey % 3 = 0 then '' else ' with: text, select, textarea' end)"
    body = "('Item ' || p_partkey || 'BHUNTCOXagainmMout')"
    return f"""select {columns} from (
  select p_partkey as page_id, n as link_id, kind as source_kind, {fill('u')} as url, {fill('t')} as title, {fill('x')} as link_text,
    case y when '=' then {body} when '{{f}}' then {form} else {fill('y')} end as description
  from part, (values {rows}) v(n, kind, u, t, x, y))"""


def _dom(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    rows = html.dom_links(_widgets(spark, d), markup=False)
    return rows.filter(F.col("source_kind").isin(*kinds)) if kinds else rows


_COLUMNS = "page_id, link_id, url, title"


@query(_sql_widgets(_COLUMNS, ("area",)))
def extract_areas(spark: SparkSession, d: str) -> DataFrame:
    return _dom(spark, d, "area").select("page_id", "link_id", "url", "title")


@query(_sql_widgets(_COLUMNS, ("form",)))
def extract_forms(spark: SparkSession, d: str) -> DataFrame:
    return _dom(spark, d, "form").select("page_id", "link_id", "url", "title")


@query(_sql_widgets(_COLUMNS, ("button",)))
def extract_buttons(spark: SparkSession, d: str) -> DataFrame:
    return _dom(spark, d, "button").select("page_id", "link_id", "url", "title")


@query(_sql_widgets(_COLUMNS, ("data",)))
def extract_data_attrs(spark: SparkSession, d: str) -> DataFrame:
    return _dom(spark, d, "data").select("page_id", "link_id", "url", "title")


@query(_sql_widgets(_COLUMNS, ("onclick",)))
def extract_onclick(spark: SparkSession, d: str) -> DataFrame:
    return _dom(spark, d, "onclick").select("page_id", "link_id", "url", "title")


@query(_sql_widgets("page_id, link_id, source_kind, title"))
def link_title(spark: SparkSession, d: str) -> DataFrame:
    return _dom(spark, d).select("page_id", "link_id", "source_kind", "title")


@query(_sql_widgets("page_id, link_id, link_text"))
def link_text(spark: SparkSession, d: str) -> DataFrame:
    return _dom(spark, d).select("page_id", "link_id", "link_text")


@query(_sql_widgets("page_id, link_id, description"))
def link_description(spark: SparkSession, d: str) -> DataFrame:
    return _dom(spark, d).select("page_id", "link_id", "description")


_ELEMENTS = (
    '<body><div class="pager"><button id="b{k}">Load more {k}</button><button></button><a class="next-page" href="#" title="Next {k}"></a><a class="next-page" href="#" title="Next {k}"></a>'
    '<span role="tab" aria-label="Tab {k}"><a href="/x">in</a></span><div class="my-button big"></div><ul class="loading-list"><li>z</li></ul></div></body>'
)


@query("""select p_partkey as page_id, id, tag_name, replace(text_content, '{k}', p_partkey::varchar) as text_content, class_names, replace(element_id, '{k}', p_partkey::varchar) as element_id,
  onclick_handler, has_children, parent_tag, replace(aria_label, '{k}', p_partkey::varchar) as aria_label
from part, (values (0, 'button', 'Load more {k}', '', 'b{k}', false, false, 'div', ''), (1, 'a', '', 'next-page', '', false, false, 'div', 'Next {k}'), (2, 'ul', 'z', 'loading-list', '', false, false, 'div', ''),
  (3, 'div', 'Load more {k}inz', 'pager', '', false, true, 'body', ''), (4, 'span', 'in', '', '', false, true, 'div', 'Tab {k}'), (5, 'div', '', 'my-button big', '', false, false, 'div', ''))
  v(id, tag_name, text_content, class_names, element_id, onclick_handler, has_children, parent_tag, aria_label)""")
def dynamic_candidates(spark: SparkSession, d: str) -> DataFrame:
    return html.dynamic_elements(_widgets(spark, d, _ELEMENTS)).drop("page_url")


_PROBES = '<body><div class="loading spinner-x" data-loading></div><div class="load-more trigger-x" id="mytrigger"></div><p class="trigger" aria-label="Loading {k}"></p></body>'


@query("""select p_partkey as page_id, rank, selector from part, (values (0, '.loading'), (3, '[data-loading]'), (4, '[class*="loading"]'), (5, '[class*="spinner"]'), (11, '[aria-label*="Loading"]')) v(rank, selector)""")
def loading_indicators(spark: SparkSession, d: str) -> DataFrame:
    return html.probed(_widgets(spark, d, _PROBES), dom.INDICATORS).select("page_id", "rank", "selector")


@query("""select p_partkey as page_id, rank, selector, hits from part, (values (0, '.load-more', 1), (6, '[id*="trigger"]', 1), (7, '[class*="trigger"]', 2)) v(rank, selector, hits)""")
def trigger_zones(spark: SparkSession, d: str) -> DataFrame:
    return html.probed(_widgets(spark, d, _PROBES), dom.ZONES)
