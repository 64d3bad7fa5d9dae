"""Registered queries. Importing a module of queries registers them."""

from siteweave.plans import ai_queries, dynamic_queries, extract_queries, graph_queries, url_queries  # noqa: F401
from siteweave.plans.registry import ORACLES, QUERIES  # noqa: F401
