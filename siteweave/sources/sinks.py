"""Sinks: crawl results as JSON, tree reports as text."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.functions import urls

RESULT_SCHEMA = "site string, products array<struct<productName:string,url:string>>, base_url string, domain string"


def result_rows(products: DataFrame) -> DataFrame:
    """One row a site of products(site, product_name, url), in order of url."""
    item = F.struct("url", F.col("product_name").alias("productName"))
    ordered = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["productName"].alias("productName"), x["url"].alias("url")))
    base = F.concat(F.lit("https://"), "site", F.lit("/"))
    return products.groupBy("site").agg(ordered.alias("products")).select("site", "products", base.alias("base_url"), urls.domain(base).alias("domain"))


def write_results(rows: DataFrame, path: str) -> None:
    """A JSON object a line, one line a site, in as many files as there are partitions."""
    rows.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(RESULT_SCHEMA).json(path).select("site", F.explode("products").alias("p"))
    return rows.select("site", F.col("p.productName").alias("product_name"), F.col("p.url").alias("url"))


def save_site(products: list[dict], pages_processed: int, total_nodes: int, base_url: str, domain: str, path: str) -> None:
    """One site's results as a single indented file, non-ASCII kept. Always written, also without products."""
    body = {"products": products, "pages_processed": pages_processed, "total_nodes": total_nodes, "base_url": base_url, "domain": domain}
    Path(path).write_text(json.dumps(body, indent=2, ensure_ascii=False), encoding="utf-8")


def clean_results(path: str, output: str | None = None) -> str:
    """Rewrite a result file without duplicate products (same name and main url; the one without a fragment stays); returns the path written.

    Without output the file's name gets _cleaned before its suffix. A file without products is copied as it is; a missing file or bad JSON raises.
    """
    body = json.loads(Path(path).read_text(encoding="utf-8"))
    target = Path(output) if output else Path(path).with_name(f"{Path(path).stem}_cleaned{Path(path).suffix}")
    kept: dict[tuple[str, str], dict] = {}
    for x in body.get("products") or []:
        key = (x.get("productName"), (x.get("url") or "").split("#")[0])
        have = kept.get(key)
        if have is None or ("#" in (x.get("url") or ""), x.get("url") or "") < ("#" in (have.get("url") or ""), have.get("url") or ""):
            kept[key] = x
    target.write_text(json.dumps({**body, "products": list(kept.values())}, indent=2, ensure_ascii=False), encoding="utf-8")
    return str(target)


def write_tree(lines: DataFrame, path: str) -> None:
    """Tree lines(site, line_no, line) as text, in order within each site; a folder a site."""
    ordered = lines.repartition("site").sortWithinPartitions("site", "line_no").select("site", F.col("line").alias("value"))
    ordered.write.mode("overwrite").partitionBy("site").text(path)
