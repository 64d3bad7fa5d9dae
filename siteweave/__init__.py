"""Crawl-corpus analytics on Spark: the crawl engine's operators under one roof."""

from siteweave.operators.crawl import best_first, bfs, explore, tree_lines, within_budget
from siteweave.operators.dynamic import exhausted, session, snapshot_links
from siteweave.operators.html import dom_content, dom_links, page_content
from siteweave.operators.products import dedup
from siteweave.operators.scoring import Scorer, join_scores, rules, with_retry
from siteweave.sources.config import CrawlConfig, load
from siteweave.sources.sinks import clean_results

__all__ = [
    "CrawlConfig", "Scorer", "best_first", "bfs", "clean_results", "dedup", "dom_content", "dom_links", "exhausted", "explore", "join_scores", "load", "page_content", "rules", "session", "snapshot_links", "tree_lines", "with_retry", "within_budget",
]
