"""Crawl operators: breadth-first levels, best-first exploration, trees and node merges.

Edges are (site, parent_url, url, pos, ...). Level loops run one join and one anti join a level and write each level to the shared
folder; best-first order is sequential within a site and parallel over sites.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.functions import text
from siteweave.scratch import written


#: Tables of levels that are read side by side before they are written as one.
KEPT_TABLES = 16


def bfs(edges: DataFrame, roots: DataFrame, max_levels: int = 1000) -> DataFrame:
    """(site, url, parent_url, level, rank) of all urls reachable from roots(site, url); siblings in document order, the first discoverer is the parent.

    The links are written once and read by each level. A graph with more levels than max_levels raises.
    """
    level = written(roots.select("site", "url", F.lit(None).cast("string").alias("parent_url"), F.lit(0).alias("level"), F.lit(1).cast("int").alias("rank")))
    visited = level
    links = written(edges.select("site", F.col("parent_url").alias("url"), F.col("url").alias("child"), "pos"))
    for n in range(1, max_levels + 1):
        found = level.select("site", "url", "rank").join(links, ["site", "url"])
        first = Window.partitionBy("site", "child").orderBy("rank", "pos")
        found = found.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("site", F.col("child").alias("url"), F.col("url").alias("parent_url"), "rank", "pos")
        fresh = found.join(visited.select("site", "url"), ["site", "url"], "left_anti")
        order = Window.partitionBy("site").orderBy("rank", "pos", "url")
        level = written(fresh.select("site", "url", "parent_url", F.lit(n).alias("level"), F.row_number().over(order).cast("int").alias("rank")))
        if level.isEmpty():
            return visited
        visited = visited.unionByName(level)
        if n % KEPT_TABLES == 0:
            visited = written(visited)
    raise RuntimeError(f"more than {max_levels} levels")


def within_budget(levels: DataFrame, max_pages: int) -> DataFrame:
    """The first max_pages urls of each site in breadth-first order, with their visit number."""
    w = Window.partitionBy("site").orderBy("level", "rank")
    return levels.withColumn("visit", F.row_number().over(w)).filter(F.col("visit") <= max_pages)


def products_found(nodes: DataFrame) -> DataFrame:
    """(site, product_name, url, found_by) of the nodes of a best-first walk that are products."""
    return nodes.filter("found_by is not null").select("site", "product_name", "url", "found_by")


NODE_SCHEMA = "site string, url string, parent_url string, depth int, score double, avg_score double, insert_seq long, pop_seq int, is_explored boolean, product_name string, found_by string"


def explore(links: dict[str, list[tuple]], root: str, max_pages: int, verdicts: dict[str, str] | None = None) -> list[tuple]:
    """Best-first walk of one site. links: page -> (url, score, product name) in order. Rows as NODE_SCHEMA without site.

    Scores under 1 are dropped, 9 and more are products, others are queued by the mean of the positive scores on the way from the root,
    fixed when queued, first in first out among equals. A popped page of 8 or more with a verdict is a product; it costs no budget
    and is not expanded. Urls met before are ignored.
    """
    verdicts = verdicts or {}
    nodes: dict[str, dict] = {root: {"url": root, "parent_url": None, "depth": 0, "score": 0.0, "path": [], "avg": 0.0, "seq": 0, "pop": None, "explored": False, "name": None, "by": None}}
    queue, counter, used, popped = [(-0.0, 0, root)], 1, 0, 0
    while queue and used < max_pages:
        _, _, url = heapq.heappop(queue)
        node = nodes[url]
        if node["explored"]:
            continue
        node["explored"], node["pop"] = True, popped
        popped += 1
        if node["score"] >= 8 and verdicts.get(url):
            node["name"], node["by"] = verdicts[url], "verify"
            continue
        used += 1
        for child, score, name in links.get(url, ()):
            if child in nodes:
                continue
            way = node["path"] + ([score] if score > 0 else [])
            new = nodes[child] = {"url": child, "parent_url": url, "depth": node["depth"] + 1, "score": score, "path": way, "avg": sum(way) / len(way) if way else 0.0, "seq": None, "pop": None, "explored": False, "name": name, "by": None}
            if score < 1 or score >= 9:
                new["explored"] = True
                new["by"] = "link" if score >= 9 and name else None
            else:
                new["seq"] = counter
                heapq.heappush(queue, (-new["avg"], counter, child))
                counter += 1
    return [(x["url"], x["parent_url"], x["depth"], x["score"], x["avg"], x["seq"], x["pop"], x["explored"], x["name"], x["by"]) for x in nodes.values()]


def best_first(edges: DataFrame, roots: DataFrame, max_pages: int, verdicts: DataFrame | None = None) -> DataFrame:
    """Nodes of every site of roots(site, url) after a best-first walk over edges(site, parent_url, url, pos, milli, product_name).

    A site's links are one group: what is grouped are links, not pages, and sites are the unit of parallelism.
    """
    rows = edges.select("site", "parent_url", "url", "pos", "milli", "product_name", F.lit("link").alias("kind"))
    start = roots.select("site", F.lit(None).cast("string").alias("parent_url"), "url", F.lit(-1).alias("pos"), F.lit(0).alias("milli"), F.lit(None).cast("string").alias("product_name"), F.lit("root").alias("kind"))
    rows = rows.unionByName(start)
    if verdicts is not None:
        rows = rows.unionByName(verdicts.select("site", F.lit(None).cast("string").alias("parent_url"), "url", F.lit(-1).alias("pos"), F.lit(0).alias("milli"), "product_name", F.lit("verdict").alias("kind")))

    def walk(b: pd.DataFrame) -> pd.DataFrame:
        links: dict[str, list[tuple]] = {}
        for x in b[b["kind"] == "link"].sort_values(["parent_url", "pos"], kind="stable").itertuples():
            links.setdefault(x.parent_url, []).append((x.url, x.milli / 1000, x.product_name))
        known = dict(b.loc[b["kind"] == "verdict", ["url", "product_name"]].itertuples(index=False))
        out = [row for root in b.loc[b["kind"] == "root", "url"] for row in explore(links, root, max_pages, known)]
        frame = pd.DataFrame(out, columns=["url", "parent_url", "depth", "score", "avg_score", "insert_seq", "pop_seq", "is_explored", "product_name", "found_by"])
        frame.insert(0, "site", b["site"].iloc[0])
        return frame.astype({"insert_seq": "Int64", "pop_seq": "Int32"})

    return rows.groupBy("site").applyInPandas(walk, NODE_SCHEMA)


def waves(edges: DataFrame, roots: DataFrame, width: int, rounds: int) -> DataFrame:
    """Best-first in supersteps: each round pops the ``width`` best queued pages of every site at once. (site, url, parent_url, avg_score, wave, is_explored).

    Scales where a single site's links don't fit one worker; order, and so parents, differ from the strict walk.
    """
    queued = edges.filter("milli >= 1000 and milli < 9000").select("site", F.col("parent_url").alias("url"), F.col("url").alias("child"), "pos", (F.col("milli") / 1000).alias("score"))
    scored = lambda c: F.when(F.size(c) == 0, 0.0).otherwise(F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c))
    nodes = written(roots.select("site", "url", F.lit(None).cast("string").alias("parent_url"), F.array().cast("array<double>").alias("path_scores"), F.lit(None).cast("int").alias("wave")))
    for n in range(rounds):
        ranked = nodes.withColumn("rn", F.when(F.col("wave").isNull(), F.row_number().over(Window.partitionBy("site", F.col("wave").isNull()).orderBy(scored(F.col("path_scores")).desc(), "url"))))
        nodes = written(ranked.withColumn("wave", F.when(F.col("rn") <= width, n).otherwise(F.col("wave"))).drop("rn"))
        popped = nodes.filter(F.col("wave") == n)
        found = popped.join(queued, ["site", "url"]).select("site", F.col("child").alias("url"), F.col("url").alias("parent_url"), F.concat("path_scores", F.array("score")).alias("path_scores"), "pos")
        one = Window.partitionBy("site", "url").orderBy("parent_url", "pos")
        fresh = found.withColumn("rn", F.row_number().over(one)).filter("rn = 1").drop("rn", "pos").join(nodes.select("site", "url"), ["site", "url"], "left_anti")
        if fresh.isEmpty():
            break
        nodes = written(nodes.unionByName(fresh.withColumn("wave", F.lit(None).cast("int"))))
    return nodes.select("site", "url", "parent_url", scored(F.col("path_scores")).alias("avg_score"), "wave", F.col("wave").isNotNull().alias("is_explored"))


def upsert(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes(site, url, path, parent_url) and the found ones whose url is new, the first of each and of each path below a parent."""
    one = Window.partitionBy("site", "url").orderBy("parent_url", "path")
    child = Window.partitionBy("site", "parent_url", "path").orderBy("url")
    fresh = found.join(nodes.select("site", "url"), ["site", "url"], "left_anti").withColumn("rn", F.row_number().over(one)).filter("rn = 1").drop("rn")
    fresh = fresh.join(nodes.select("site", "parent_url", "path"), ["site", "parent_url", "path"], "left_anti").withColumn("rn", F.row_number().over(child)).filter("rn = 1").drop("rn")
    return nodes.unionByName(fresh.select(*nodes.columns))


def upsert_scored(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Full merge by (site, url): the parent stays, the score is the new one where there is one."""
    a, b = nodes.alias("a"), found.alias("b")
    on = (F.col("a.site") == F.col("b.site")) & (F.col("a.url") == F.col("b.url"))
    pick = lambda c, *order: F.coalesce(*(F.col(f"{x}.{c}") for x in order)).alias(c)
    return a.join(b, on, "full").select(pick("site", "a", "b"), pick("url", "a", "b"), pick("parent_url", "a", "b"), pick("score", "b", "a"))


def average(scores: Column) -> Column:
    """Mean of the positive entries of an array, 0 if none."""
    good = F.filter(scores, lambda x: x > 0)
    return F.when(F.size(good) == 0, 0.0).otherwise(F.aggregate(good, F.lit(0.0), lambda a, x: a + x) / F.size(good))


def tree_lines(nodes: DataFrame, max_levels: int = 1000) -> DataFrame:
    """(site, line_no, line) of the trees of nodes(site, url, path, parent_url, is_explored); a root has no parent. A tree deeper than max_levels raises."""
    stats = nodes.filter("parent_url is not null").groupBy("site", F.col("parent_url").alias("url")).agg(F.count("*").alias("total"), F.count_if("is_explored").alias("explored"))
    every = written(nodes.join(stats, ["site", "url"], "left").fillna(0, ["total", "explored"]))
    siblings = Window.partitionBy("site", "parent_url").orderBy("path")
    kids = every.filter("parent_url is not null").withColumn("is_last", F.lead("path").over(siblings).isNull())
    label = F.concat(F.when(F.col("is_last"), "└── ").otherwise("├── "), F.when(F.col("is_explored"), "✓").otherwise("○"), F.lit(" "), F.when(F.col("path") == "", "(root)").otherwise(F.col("path")), F.lit(" ["), "explored", F.lit("/"), "total", F.lit(" explored]"))
    level = every.filter("parent_url is null").withColumn("is_last", F.lit(True)).withColumn("prefix", F.lit("")).withColumn("key", F.array().cast("array<string>"))
    out = None
    for _ in range(max_levels + 1):
        level = written(level.select("site", "url", "is_last", "prefix", "key", F.concat("prefix", label).alias("line")))
        if level.isEmpty():
            break
        out = level.select("site", "key", "line") if out is None else out.union(level.select("site", "key", "line"))
        up = level.select("site", F.col("url").alias("parent_url"), F.concat("prefix", F.when(F.col("is_last"), "    ").otherwise("│   ")).alias("prefix"), "key")
        level = kids.join(up, ["site", "parent_url"]).withColumn("key", F.concat("key", F.array("path")))
    else:
        raise RuntimeError(f"a tree is deeper than {max_levels} levels")
    return out.select("site", F.row_number().over(Window.partitionBy("site").orderBy("key")).cast("int").alias("line_no"), "line")


def routed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("score", F.col("milli") / 1000).withColumn("band", text.route(F.col("milli") / 1000))
