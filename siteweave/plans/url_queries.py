"""Queries over urls: splitting, resolution, names, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.functions import text, urls
from siteweave.operators import html
from siteweave.plans.registry import CATALOG, HREFS, query, sql_domain, sql_path, sql_query, sql_relative
from siteweave.sources.tables import edges, table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


@query(f"select page_id, url, {sql_domain('url')} as site, length(html) as html_chars from pages")
def scan_pages(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", "url", urls.domain(F.col("url")).alias("site"), F.length("html").cast("long").alias("html_chars"))


@query(f"select page_id, {sql_domain('url')} as domain from pages")
def url_domain(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", urls.domain(F.col("url")).alias("domain"))


#: References of every form, chosen by page; the expected results spell out RFC 3986 for paths below /.
_REFS = [
    ("x/y.html", "{o}{dir}x/y.html"),
    ("../up", "{o}{up}up"),
    ("./here?z=1", "{o}{dir}here?z=1"),
    ("?only=query", "{o}{rp}?only=query"),
    ("//other.test/a/../b", "{s}://other.test/a/../b"),
    ("#frag", "{nofrag}#frag"),
    ("https://abs.test/p;v=1?q#f", "https://abs.test/p;v=1?q#f"),
    ("/root/./a/../b/", "{o}/root/b/"),
    ("/p;x=1?y=2#z", "{o}/p;x=1?y=2#z"),
    ("sms:123", "sms:123"),
    ("..", "{o}{up}"),
    ("", "{u}"),
]


def _refs(c: str) -> str:
    return "case " + " ".join(f"when {c} % {len(_REFS)} = {k} then '{r}'" for k, (r, _) in enumerate(_REFS)) + " end"


def _expected() -> str:
    def sql(template: str) -> str:
        out = template
        parts = []
        while "{" in out:
            a, z = out.index("{"), out.index("}")
            parts += [f"'{out[:a]}'"] * bool(out[:a]) + [out[a + 1 : z]]
            out = out[z + 1 :]
        return " || ".join(parts + [f"'{out}'"] * bool(out))

    return "case " + " ".join(f"when page_id % {len(_REFS)} = {k} then {sql(t)}" for k, (_, t) in enumerate(_REFS)) + " end"


_RESOLVED = f"""resolved as (
  select page_id, u, {_refs('page_id')} as href, {_expected()} as url from (
    select page_id, url as u, regexp_extract(url, '^[^:/?#]+://[^/?#]*') as o, regexp_extract(url, '^([^:/?#]+)://', 1) as s, regexp_replace(url, '#.*$', '') as nofrag,
      regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) as rp,
      regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') as dir,
      regexp_replace(regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), '[^/]+/$', '') as up
    from pages))"""


def _with_refs(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", F.col("url").alias("u"), F.expr(_refs("page_id")).alias("href"))


@query(f"with {_RESOLVED} select page_id, href, url from resolved")
def url_resolve(spark: SparkSession, d: str) -> DataFrame:
    return _with_refs(spark, d).select("page_id", "href", urls.resolve(F.col("u"), F.col("href")).alias("url"))


@query(f"with {_RESOLVED} select page_id, case when href = 'sms:123' then 'sms://123' else regexp_extract(url, '^[^/]+//[^/?#]*') || {sql_relative('url')} end as url from resolved")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _with_refs(spark, d).select("page_id", urls.normalize(F.col("u"), F.col("href")).alias("url"))


@query(f"with {_RESOLVED} select page_id, href, regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') as valid from resolved")
def url_valid(spark: SparkSession, d: str) -> DataFrame:
    return _with_refs(spark, d).select("page_id", "href", urls.is_valid(F.col("href")).alias("valid"))


@query(f"select page_id, case when trim({sql_path('url')}, '/') = '' then []::varchar[] else string_split(trim({sql_path('url')}, '/'), '/') end as parts from pages")
def path_components(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", urls.path_components(F.col("url")).alias("parts"))


@query(f"with {HREFS} select page_id, pos, case when {sql_relative('url')} = '/' then '' else {sql_relative('url')} end as path from links")
def url_tree_path(spark: SparkSession, d: str) -> DataFrame:
    return html.resolved(html.anchors(_pages(spark, d))).select("page_id", "pos", urls.tree_path(F.col("url")).alias("path"))


@query(f"with {HREFS} select page_id, pos, {sql_relative('url')} as relative_path from links")
def url_relative_path(spark: SparkSession, d: str) -> DataFrame:
    return html.resolved(html.anchors(_pages(spark, d))).select("page_id", "pos", urls.relative_path(F.col("url")).alias("relative_path"))


@query("select page_id, rtrim(url, '/') as base from pages")
def base_url_trim(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", urls.trim_slashes(F.col("url")).alias("base"))


@query("select page_id, regexp_replace(url || '|a<b>\"c\"*', '[<>:\"/\\\\|?*]', '_', 'g') as name from pages")
def sanitize_filename(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", urls.sanitize_filename(F.concat("url", F.lit('|a<b>"c"*'))).alias("name"))


_SIZES = "(select l_orderkey, l_linenumber, (l_partkey * l_partkey * (l_linenumber - 1) * (l_linenumber - 1) * 37)::bigint as n from lineitem)"


@query(f"""select l_orderkey, l_linenumber, n, case when n = 0 then '0B' else printf('%.1f', n / pow(1024.0, k)) || ['B', 'KB', 'MB', 'GB'][k + 1] end as size
from (select *, case when n < 1024 then 0 when n < 1048576 then 1 when n < 1073741824 then 2 else 3 end as k from {_SIZES})""")
def format_size(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber") - 1
    n = (F.col("l_partkey") * F.col("l_partkey") * k * k * 37).cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n"), text.format_size(n).alias("size"))


@query("select doc_id, substr(text, 1, 100) as title, substr(text, 1, 200) as description, case when length(text) > 3000 then substr(text, 1, 3000) || '...' else text end as page_text from documents")
def truncate_fields(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.substring(t, 1, 100).alias("title"), F.substring(t, 1, 200).alias("description"), text.truncated(t, 3000).alias("page_text"))


_STRIP = "regexp_replace({}, '^[\\s]+|[\\s]+$', '', 'g')"


@query(f"select doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[\\n\\r]+|  '), lambda x: {_STRIP.format('x')}), lambda x: x <> ''), ' ') as cleaned from documents")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


_BANDS = "case when milli < 1000 then 'very_low' when milli < 5000 then 'low' when milli < 8000 then 'medium' when milli < 9000 then 'high' else 'very_high' end"
_PROMPT = "case when milli < 1000 then 'never' when milli < 4000 then 'last_choice' when milli < 8000 then 'right_path' when milli < 9000 then 'likely' else 'very_likely' end"


@query(f"with {CATALOG} select site, {_BANDS} as band, count(*) as n from edges group by all")
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("site", text.score_band(F.col("milli") / 1000).alias("band")).agg(F.count("*").alias("n"))


@query(f"with {CATALOG} select site, {_PROMPT} as band, count(*) as n from edges group by all")
def prompt_bands(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("site", text.prompt_band(F.col("milli") / 1000).alias("band")).agg(F.count("*").alias("n"))


#: Task settings made from suppliers: url always, the others present for some.
_CONFIGS = """select s_suppkey, 'https://supplier-' || s_suppkey || '.example.test' as url, case when s_suppkey % 2 = 0 then 1.5 end as delay, case when s_suppkey % 3 = 0 then 100 end as max_pages,
  case when s_suppkey % 5 = 0 then true end as enable_dynamic_loading, case when s_suppkey % 4 = 0 then 'out/results.v2.json' when s_suppkey % 4 = 1 then 'plain' end as output from supplier"""


@query(f"select s_suppkey, url, coalesce(delay, 1.0)::double as delay, coalesce(max_pages, 50)::int as max_pages, coalesce(enable_dynamic_loading, false) as enable_dynamic_loading from ({_CONFIGS})")
def config_defaults(spark: SparkSession, d: str) -> DataFrame:
    from siteweave.sources.config import with_defaults

    return with_defaults(_configs(spark, d)).select("s_suppkey", "url", "delay", "max_pages", "enable_dynamic_loading")


def _configs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("https://supplier-"), k, F.lit(".example.test")).alias("url"),
        F.when(k % 2 == 0, 1.5).alias("delay"),
        F.when(k % 3 == 0, 100).alias("max_pages"),
        F.when(k % 5 == 0, True).alias("enable_dynamic_loading"),
        F.when(k % 4 == 0, "out/results.v2.json").when(k % 4 == 1, "plain").alias("output"),
    )


@query(f"""select s_suppkey,
  case when output is null then 'ai_crawl_results_' || host || '_raw.json' when output = 'plain' then 'plain_raw' else 'out/results.v2_raw.json' end as raw_output,
  coalesce(output, 'ai_crawl_results_' || host || '.json') as final_output,
  case when output is null then 'ai_crawl_results_' || host || '_raw_cleaned.json' when output = 'plain' then 'plain_raw_cleaned' else 'out/results.v2_raw_cleaned.json' end as default_cleaned
from (select *, replace(replace(url, 'https://', ''), '.', '_') as host from ({_CONFIGS}))""")
def output_names(spark: SparkSession, d: str) -> DataFrame:
    from siteweave.sources.config import default_names, suffixed

    raw, final = default_names(F.col("url"), F.col("output"))
    return _configs(spark, d).select("s_suppkey", raw.alias("raw_output"), final.alias("final_output"), suffixed(raw, "_cleaned").alias("default_cleaned"))



@query(f"with {HREFS} select page_id, pos, href from hrefs where href <> '' and not regexp_matches(href, '^(#|javascript:|mailto:|tel:)')")
def filter_schemes(spark: SparkSession, d: str) -> DataFrame:
    rows = html.anchors(_pages(spark, d))
    return rows.filter(urls.link_scheme_ok(F.col("href"))).select("page_id", "pos", "href")


@query(f"with {_RESOLVED} select page_id, url from resolved where not (href like '//other%' or href like 'https://abs%')")
def filter_same_domain(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_refs(spark, d).withColumn("url", urls.resolve(F.col("u"), F.col("href")))
    return rows.filter(urls.same_domain(F.col("url"), F.col("u"))).select("page_id", "url")
