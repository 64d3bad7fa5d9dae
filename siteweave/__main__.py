"""python -m siteweave task.json --pages PAGES [--scores SCORES] [--verdicts VERDICTS] [--snapshots S --triggers T] [--walk bfs]: a crawl over recorded pages.

PAGES is a Parquet table (page_id, url, html), SCORES (parent_url, url, milli, product_name; without it the offline rules score), VERDICTS
(url, product_name). With enable_dynamic_loading in the task, SNAPSHOTS (url, trigger_id, step, html) and TRIGGERS (page_url, trigger_id,
trigger_type) give the links that a page shows after clicks. A guided crawl writes the raw and the cleaned result file of the task and lists the
products; ``--walk bfs`` lists the pages in breadth-first order instead. Pages are recorded, so delay and provider have no effect; a task that sets them
is told so. Exit status 1 on any error.
"""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteweave.operators import crawl, dynamic, html, products, scoring
from siteweave.sources import config, sinks

log = logging.getLogger("siteweave")


def names(task: config.CrawlConfig) -> tuple[str, str]:
    host = urlsplit(task.url).netloc.replace(".", "_")
    final = Path(task.output or f"ai_crawl_results_{host}.json")
    return str(final.with_name(f"{final.stem}_raw{final.suffix}")), str(final)


def page_links(spark: SparkSession, task: config.CrawlConfig, pages: str, snapshots: str | None = None, triggers: str | None = None) -> DataFrame:
    """(site, parent_url, url, pos, title) of the task's site: the pages' links in order, then those that dynamic loading shows."""
    site = urlsplit(task.url).netloc
    links = html.dom_links(spark.read.parquet(pages), markup=False).filter(F.col("site") == site).select("site", F.col("page_url").alias("parent_url"), "url", "pos", "title")
    if not task.enable_dynamic_loading:
        return links
    if not (snapshots and triggers):
        log.warning("dynamic loading is enabled, but there are no snapshots and triggers")
        return links
    shown = dynamic.snapshot_links(spark.read.parquet(snapshots))
    found = dynamic.session(shown, spark.read.parquet(triggers), links.select(F.col("parent_url").alias("page_url"), "url"))
    place = shown.groupBy("page_url", "trigger_id", "step", "url").agg(F.min("pos").alias("at"))
    order = Window.partitionBy("page_url").orderBy("trigger_id", "step", "at")
    last = links.groupBy("parent_url").agg(F.max("pos").alias("last"))
    more = found.join(place, ["page_url", "trigger_id", "step", "url"]).withColumn("n", F.row_number().over(order)).withColumnRenamed("page_url", "parent_url")
    more = more.join(last, "parent_url", "left").select(F.lit(site).alias("site"), "parent_url", "url", (F.coalesce("last", F.lit(-1)) + F.col("n")).cast("int").alias("pos"), F.lit("").alias("title"))
    return links.unionByName(more)


def run(spark: SparkSession, task: config.CrawlConfig, pages: str, scores: str | None = None, verdicts: str | None = None, snapshots: str | None = None, triggers: str | None = None) -> dict:
    """The task's summary: products (listed) before and after cleaning, pages processed, nodes."""
    site = urlsplit(task.url).netloc
    root = task.url.rstrip("/")
    links = page_links(spark, task, pages, snapshots, triggers)
    if scores:
        scored = links.join(spark.read.parquet(scores).select("parent_url", "url", "milli", "product_name"), ["parent_url", "url"], "left").fillna(0, ["milli"])
    else:
        scored = scoring.rules(links)
    roots = spark.createDataFrame([(site, root)], "site string, url string")
    known = spark.read.parquet(verdicts).select(F.lit(site).alias("site"), "url", "product_name") if verdicts else None
    nodes = crawl.best_first(scored, roots, task.max_pages, known).persist()
    found = crawl.products_found(nodes).drop("found_by")
    total = nodes.agg(F.count("*"), F.count_if("is_explored")).first()
    raw, final = names(task)
    listed = lambda df: [{"productName": r["product_name"], "url": r["url"]} for r in df.orderBy("url").toLocalIterator()]
    before, after = listed(found), listed(products.dedup(found))
    sinks.save_site(before, total[1], total[0], task.url, site, raw)
    sinks.save_site(after, total[1], total[0], task.url, site, final)
    nodes.unpersist()
    return {"products": len(before), "cleaned": len(after), "pages_processed": total[1], "total_nodes": total[0], "raw": raw, "final": final, "listed": after}


def walk(spark: SparkSession, task: config.CrawlConfig, pages: str, snapshots: str | None = None, triggers: str | None = None) -> list[str]:
    """The urls of the task's site in breadth-first order, max_pages at most."""
    links = page_links(spark, task, pages, snapshots, triggers)
    roots = spark.createDataFrame([(urlsplit(task.url).netloc, task.url.rstrip("/"))], "site string, url string")
    return [r["url"] for r in crawl.within_budget(crawl.bfs(links, roots), task.max_pages).orderBy("visit").collect()]


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siteweave")
    parser.add_argument("config")
    parser.add_argument("--pages", required=True)
    for name in ("scores", "verdicts", "snapshots", "triggers"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--walk", choices=("guided", "bfs"), default="guided")
    parser.add_argument("--verbose", action="store_true")
    a = parser.parse_args(args)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO)
    try:
        task = config.load(a.config)
        if task.ai_provider or task.ai_model or task.delay != config.CrawlConfig.delay:
            log.info("pages and scores are recorded: delay and provider have no effect")
        spark = SparkSession.builder.getOrCreate()
        if a.walk == "bfs":
            for n, url in enumerate(walk(spark, task, a.pages, a.snapshots, a.triggers), 1):
                print(f"{n}. {url}")
            return 0
        summary = run(spark, task, a.pages, a.scores, a.verdicts, a.snapshots, a.triggers)
    except Exception:
        log.exception("the crawl failed")
        return 1
    for n, product in enumerate(summary.pop("listed"), 1):
        print(f"{n}. {product['productName']}: {product['url']}")
    for k, v in summary.items():
        print(f"  {k}: {v}")
    return 0


def command() -> None:
    """The console script."""
    sys.exit(main())


if __name__ == "__main__":
    command()
