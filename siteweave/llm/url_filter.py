"""URL filter: host/path rules first, then logistic regression on hashed character n-grams.

Native: scoring is one projection of built-in functions, with no shuffle, join or Python.
The model is fitted on the driver from a labelled URL table of at most MAX_LABELLED rows (``url_table``, or any other).

Defined results: a null url, or one without ``://``, has empty host and path; such a row and any
row that no rule fits takes the model's verdict (which allows an empty url). Every input row gives one output row; repeated
rows give repeated results; columns other than page_id and url are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm import url_table
from siteweave.llm.common import LOWER, UPPER, ascii_lower

#: Bound of the training table.
MAX_LABELLED = 10_000
#: Number of hash bins (a prime), n-gram lengths and hash base.
BINS, ORDERS, BASE = 16381, (3, 4, 5), 31
THRESHOLD = 0.5
#: Weight of an ordinary training row against an unwanted one: blocking a good page costs more.
ORDINARY_WEIGHT = 2.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

def split_url(url: str | None) -> tuple[str, str]:
    """The (host, path) that the column expressions below give, for training rows and tests."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return rest[:end].translate(str.maketrans(UPPER, LOWER)), path[:stop]


def _bins(text: str, salt: int) -> list[int]:
    codes, out = [ord(c) for c in text], []
    for n in ORDERS:
        for i in range(len(codes) - n + 1):
            h = salt
            for c in codes[i : i + n]:
                h = h * BASE + c
            out.append(h % BINS)
    return out


@lru_cache(maxsize=4)
def train(rows: tuple[tuple[str, int], ...] | None = None, rounds: int = 150, rate: float = 0.5, decay: float = 2e-6) -> tuple[tuple[float, ...], float]:
    """Full-batch descent, with a step per weight, on mean-pooled n-gram bins. Returns rounded weights and bias."""
    rows = url_table.rows() if rows is None else rows
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table has {len(rows)} rows, more than {MAX_LABELLED}")
    feats = [_bins(h, 1) + _bins(p, 2) for h, p in (split_url(u) for u, _ in rows)]
    y, sizes = np.array([float(label) for _, label in rows]), np.array([len(f) for f in feats])
    column, row = np.array([b for f in feats for b in f], np.int64), np.repeat(np.arange(len(rows)), sizes)
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    weight = np.where(y == 1, 1.0, ORDINARY_WEIGHT)
    weight = weight / weight.sum()
    w, b, squares, square = np.zeros(BINS), 0.0, np.full(BINS, 1e-12), 1e-12
    for _ in range(rounds):
        z = b + np.bincount(row, weights=w[column], minlength=len(rows)) * scale
        g = (1 / (1 + np.exp(-z)) - y) * weight
        slope, lift = np.bincount(column, weights=(g * scale)[row], minlength=BINS) + decay * w, g.sum()
        squares, square = squares + slope**2, square + lift**2
        w, b = w - rate * slope / np.sqrt(squares), b - rate * lift / math.sqrt(square)
    return tuple(np.round(w, 4).tolist()), round(float(b), 4)


def _code_bins(codes: Column, n: int, salt: int) -> Column:
    """Bins of the n-grams of an array of code points; empty if it has fewer than n."""

    def bin_at(i: Column) -> Column:
        h = F.lit(salt).cast("long")
        for k in range(n):
            h = h * BASE + F.element_at(codes, i + k)
        return h % BINS

    return F.when(F.size(codes) >= n, F.transform(F.sequence(F.lit(1), F.size(codes) - (n - 1)), bin_at)).otherwise(F.array().cast("array<bigint>"))


def _codes(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, model: tuple[tuple[float, ...], float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's, for every row)."""
    weights, bias = model or train()
    parts = pages.select(
        "page_id",
        ascii_lower(F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))).alias("host"),
        F.coalesce(F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )
    fits, verdicts = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is tested first
        hit = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        fits = F.when(hit, F.lit(r.text)).otherwise(fits)
        verdicts = F.when(hit, F.lit(r.verdict)).otherwise(verdicts)
    table = F.from_json(F.lit(str(list(weights))), "array<double>")
    bins = F.concat(*(_code_bins(F.col(c), n, salt) for c, salt in (("host_codes", 1), ("path_codes", 2)) for n in ORDERS))
    z = F.aggregate("bins", F.lit(0.0), lambda acc, x: acc + F.element_at(table, (x + 1).cast("int"))) / F.sqrt(F.greatest(F.size("bins"), F.lit(1)))
    return (
        parts.withColumns({"host_codes": _codes(F.col("host")), "path_codes": _codes(F.col("path"))})
        .withColumn("bins", bins)
        .withColumn("score", F.round(1 / (1 + F.exp(-(z + bias))), 6))
        .select("page_id", "host", "path", fits.alias("rule"), F.coalesce(verdicts, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
    )


def oracle(rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for filter_urls(pages) without the score."""
    weights, bias = train()
    grams = []
    for codes, salt in (("hc", 1), ("pc", 2)):
        for n in ORDERS:
            h = str(salt)
            for k in range(n):
                h = f"({h} * {BASE} + {codes}[i + {k}])"
            grams.append(f"list_transform(range(1, greatest(len({codes}) - {n - 2}, 1)), lambda i: w[({h} % {BINS}) + 1])")
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    hit = {r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')" for r in ranked}
    case = lambda of: "case " + " ".join(f"when {hit[r]} then '{of(r)}'" for r in ranked) + " end"
    return f"""
with parts as (
  select page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
codes as (
  select *, list_transform(regexp_extract_all(host, '(?s:.)'), lambda c: unicode(c)::bigint) as hc,
    list_transform(regexp_extract_all(path, '(?s:.)'), lambda c: unicode(c)::bigint) as pc
  from parts),
scored as (
  select page_id, host, path, coalesce(list_sum(v), 0) / sqrt(greatest(len(v), 1)) + {bias} as z
  from (select *, {" || ".join(grams)} as v from codes, (select {list(weights)}::double[] as w)))
select page_id, host, path, {case(lambda r: r.text)} as rule,
  coalesce({case(lambda r: r.verdict)}, case when round(1 / (1 + exp(-z)), 6) >= {threshold} then 'block' else 'allow' end) as verdict
from scored"""
