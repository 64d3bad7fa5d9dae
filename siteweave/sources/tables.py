"""Sources: driver tables, the catalogue graph over them, and generated page, reply and snapshot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Enumerated part types are numbered by a window over their distinct values, which a schema bounds.
MOST_TYPES = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, base, partkey, name, bn (brand number), r (rank of the type): every part a supplier's site offers."""
    part = table(spark, sf_dir, "part")
    types = [x[0] for x in part.select("p_type").distinct().orderBy("p_type").limit(MOST_TYPES + 1).collect()]
    if len(types) > MOST_TYPES:
        raise ValueError("p_type is not an enumeration")
    rank = F.array_position(F.lit(types), F.col("p_type")).cast("int") - 1
    offers = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    parts = part.select("p_partkey", "p_name", F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("bn"), rank.alias("r"))
    site = F.concat(F.lit("supplier-"), F.col("l_suppkey"), F.lit(".example.test"))
    return offers.join(parts, offers["l_partkey"] == parts["p_partkey"]).select(site.alias("site"), F.concat(F.lit("https://"), site).alias("base"), F.col("p_partkey").alias("partkey"), F.col("p_name").alias("name"), "bn", "r")


def product_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from type pages to products, some twice with a fragment: site, parent_url, url, pos, title, milli, product_name."""
    k = F.col("partkey") % 10
    milli = F.when(k == 0, 500).when(k <= 2, 8000 + 100 * k).otherwise(9000 + 100 * k).cast("int")
    url = F.concat("base", F.lit("/p/"), "partkey")
    rows = catalog(spark, sf_dir).withColumn("frag", F.explode(F.when(F.col("partkey") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        "site",
        F.concat("base", F.lit("/b/"), "bn", F.lit("/"), "r").alias("parent_url"),
        F.concat(url, F.when(F.col("frag") == 1, "#reviews").otherwise("")).alias("url"),
        (F.col("partkey") * 2 + F.col("frag")).cast("int").alias("pos"),
        F.col("name").alias("title"),
        milli.alias("milli"),
        F.when(milli >= 9000, F.col("name")).alias("product_name"),
    )


def walk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queued part of the graph: root to brands to types."""
    pairs = catalog(spark, sf_dir).select("site", "base", "bn", "r").distinct()
    brand = F.concat("base", F.lit("/b/"), "bn")
    brands = pairs.select("site", F.concat("base", F.lit("/")).alias("parent_url"), brand.alias("url"), F.col("bn").alias("pos"), F.concat(F.lit("Brand "), "bn").alias("title"), (7999 - 20 * F.col("bn")).cast("int").alias("milli")).distinct()
    types = pairs.select("site", brand.alias("parent_url"), F.concat(brand, F.lit("/"), "r").alias("url"), F.col("r").alias("pos"), F.concat(F.lit("Type "), "r").alias("title"), (4000 + 50 * F.col("bn") + 7 * F.col("r")).cast("int").alias("milli"))
    return brands.union(types).withColumn("product_name", F.lit(None).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk_edges(spark, sf_dir).unionByName(product_edges(spark, sf_dir))
