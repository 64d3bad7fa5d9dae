"""Products: emission from links and verified pages, removal of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteweave.functions import urls


def from_links(edges: DataFrame) -> DataFrame:
    """Links of 9 or more with a name."""
    return edges.filter("milli >= 9000 and product_name is not null").select("site", "product_name", "url", F.lit("link").alias("found_by"))


def from_verdicts(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Queued links of 8 or more whose page was verified; verdicts(site, url, product_name)."""
    near = edges.filter("milli >= 8000 and milli < 9000").select("site", "url")
    return near.join(verdicts, ["site", "url"]).select("site", "product_name", "url", F.lit("verify").alias("found_by"))


def dedup(products: DataFrame) -> DataFrame:
    """One row per site, name and main url; the one without a fragment if there is one."""
    main = urls.without_fragment(F.col("url"))
    w = Window.partitionBy("site", "product_name", main).orderBy(F.col("url").contains("#"), "url")
    return products.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
