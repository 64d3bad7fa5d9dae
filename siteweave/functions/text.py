"""Text and HTML functions as column expressions: titles, page text, sizes, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANCHOR = r'<a[^>]*href="([^"]*)"'
#: Named character references decoded by the fast path, the ampersand last (fixed values).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def unescape(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(ANCHOR), 1)


def visible(fragment: Column) -> Column:
    """Text of a fragment: tags out, references decoded, ends trimmed."""
    return strip(unescape(F.regexp_replace(fragment, r"<[^>]*>", "")))


def title(html: Column) -> Column:
    return strip(unescape(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)))


def description(html: Column) -> Column:
    """Meta description, else the first h1, else (where no h1 is) the first paragraph's first 200 characters."""
    meta = strip(unescape(F.regexp_extract(html, r'(?s)<meta name="description" content="([^"]*)"', 1)))
    h1, p = F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1), F.regexp_extract(html, r"(?s)<p[^>]*>(.*?)</p>", 1)
    return F.when(meta != "", meta).when(html.rlike(r"<h1[\s>]"), visible(h1)).otherwise(F.substring(visible(p), 1, 200))


def clean(text: Column) -> Column:
    """Lines and double spaces cut, pieces trimmed, empty ones dropped, joined by single spaces."""
    pieces = F.transform(F.split(text, r"[\n\r]+|  "), strip)
    return F.array_join(F.filter(pieces, lambda x: x != ""), " ")


def page_text(html: Column, limit: int = 3000) -> Column:
    bare = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    text = clean(unescape(F.regexp_replace(bare, r"<[^>]*>", "")))
    return truncated(text, limit)


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def count(html: Column, pattern: str) -> Column:
    return F.regexp_count(html, F.lit(pattern)).cast("long")


#: Patterns of the content metrics (fixed values).
METRICS = {
    "link_count": r"<a\s[^>]*href=",
    "image_count": r"<img[\s>/]",
    "product_count": r'<[a-z0-9]+\s[^>]*(?:data-product|class="[^"]*product|class="(?:[^"]* )?item[ "])',
    "card_count": r'<[a-z0-9]+\s[^>]*class="[^"]*card',
    "list_item_count": r'<li[\s>]|<(?:[a-km-z][a-z0-9]*|l|l[a-hj-z][a-z0-9]*)\s[^>]*class="[^"]*item',
    "total_elements": r"<[a-zA-Z][^>]*>",
}


def metrics(html: Column) -> dict[str, Column]:
    bare = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<!--.*?-->", "<script>")
    return {name: count(bare, p) for name, p in METRICS.items()}


def format_size(n: Column) -> Column:
    """0B, or one decimal of B, KB, MB or GB; ties of the decimal go to the even digit, as the exact binary value says."""
    out = F.lit(None).cast("string")
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        x = n.cast("double") / (1024.0**k)
        tenths = F.rint(x * 10).cast("long")
        text = F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit(unit))
        out = text if unit == "GB" else F.when(n < 1024 ** (k + 1), text).otherwise(out)
    return F.when(n == 0, "0B").otherwise(out)


# Bounds of the bands below are fixed values.
def score_band(score: Column) -> Column:
    return F.when(score < 1, "very_low").when(score < 5, "low").when(score < 8, "medium").when(score < 9, "high").otherwise("very_high")


def prompt_band(score: Column) -> Column:
    return F.when(score < 1, "never").when(score < 4, "last_choice").when(score < 8, "right_path").when(score < 9, "likely").otherwise("very_likely")


def route(score: Column) -> Column:
    return F.when(score < 1, "skip").when(score >= 9, "product").otherwise("queue")
