"""Extraction operators over pages(page_id, url, html): the regular fast path and the DOM path."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteweave.functions import dom, text, urls

LINK_SCHEMA = "page_id long, page_url string, site string, pos int, source_kind string, href string, url string, relative_path string, title string, link_text string, description string, link_tag string, link_id int"
ELEMENT_SCHEMA = "page_id long, page_url string, id int, tag_name string, text_content string, class_names string, element_id string, onclick_handler boolean, has_children boolean, parent_tag string, aria_label string"


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, page_url, site, pos, href (trimmed) of every double-quoted anchor; built-in functions only."""
    return pages.select("page_id", F.col("url").alias("page_url"), urls.domain(F.col("url")).alias("site"), F.posexplode(text.hrefs(F.col("html"))).alias("pos", "href")).withColumn("href", text.strip(F.col("href")))


def resolved(anchor_rows: DataFrame) -> DataFrame:
    """Anchors with an accepted scheme, and their absolute url."""
    return anchor_rows.filter(urls.link_scheme_ok(F.col("href"))).withColumn("url", urls.resolve(F.col("page_url"), F.col("href")))


def first_in_page(rows: DataFrame) -> DataFrame:
    """The first occurrence of each url of a page."""
    w = Window.partitionBy("page_id", "url").orderBy("pos")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def dom_links(pages: DataFrame, strict: bool = False, markup: bool = True) -> DataFrame:
    """All link kinds of arbitrary HTML, filtered and numbered per page; one pass in Arrow batches. Without markup, link_tag is empty and costs nothing."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, u, h in zip(b["page_id"], b["url"], b["html"], strict=True):
                for x in dom.links(h or "", u or "", strict=strict, markup=markup):
                    out.append((i, u, dom._netloc(u or ""), x["pos"], x["kind"], x["href"], x["url"], x["relative_path"], x["title"], x["link_text"], x["description"], x["link_tag"], x["link_id"]))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in LINK_SCHEMA.split(", ")])

    return pages.select("page_id", "url", "html").mapInPandas(rows, LINK_SCHEMA)


def dom_content(pages: DataFrame, entities: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """page_content() for any markup: attributes in any order and case, every character reference, unclosed tags. With entities, by the rules that dom.content() states for them; null html then gives nulls."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(None, None, None) if h is None and entities is not None else dom.content(h or "", entities=entities) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], **{c: [x[k] for x in found] for k, c in enumerate(("title", "description", "text_content"))}})

    return pages.select("page_id", "url", "html").mapInPandas(rows, "page_id long, url string, title string, description string, text_content string")


def dynamic_elements(pages: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [{"page_id": i, "page_url": u, **e} for i, u, h in zip(b["page_id"], b["url"], b["html"], strict=True) for e in dom.candidates(h or "")]
            yield pd.DataFrame(out, columns=[f.split()[0] for f in ELEMENT_SCHEMA.split(", ")])

    return pages.select("page_id", "url", "html").mapInPandas(rows, ELEMENT_SCHEMA)


def probed(pages: DataFrame, selectors: tuple[tuple[str, ...], ...]) -> DataFrame:
    """page_id, rank, selector, hits of the selectors that match."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [dom.spelled(s) for s in selectors]
        for b in batches:
            out = [(i, names.index(s), s, n) for i, h in zip(b["page_id"], b["html"], strict=True) for s, n in dom.probe(h or "", selectors)]
            yield pd.DataFrame(out, columns=["page_id", "rank", "selector", "hits"])

    return pages.select("page_id", "html").mapInPandas(rows, "page_id long, rank int, selector string, hits long")


def page_content(pages: DataFrame) -> DataFrame:
    h = F.col("html")
    return pages.select("page_id", "url", text.title(h).alias("title"), text.description(h).alias("description"), text.page_text(h).alias("text_content"))
