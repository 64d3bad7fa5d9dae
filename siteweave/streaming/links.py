"""Streaming counterparts (an extension: the batch engine needs none): new pages become links, each url of a site once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.functions import text, urls

PAGES = "page_id long, url string, html string, fetched timestamp"


def read_pages(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def discovered(pages: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(site, url, page_url, fetched): links on first sight; a repeat within the watermark's lateness is dropped, state older than that goes."""
    rows = pages.select(F.col("url").alias("page_url"), urls.domain(F.col("url")).alias("site"), "fetched", F.explode(text.hrefs(F.col("html"))).alias("href"))
    rows = rows.withColumn("href", text.strip(F.col("href"))).filter(urls.link_scheme_ok(F.col("href"))).withColumn("url", urls.resolve(F.col("page_url"), F.col("href")))
    rows = rows.filter(urls.same_domain(F.col("url"), F.col("page_url"))).select("site", "url", "page_url", "fetched")
    return rows.withWatermark("fetched", lateness).dropDuplicatesWithinWatermark(["site", "url"])


def rates(links: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Links per site and window of time."""
    return links.withWatermark("fetched", window).groupBy(F.window("fetched", window), "site").agg(F.count("*").alias("n"))
