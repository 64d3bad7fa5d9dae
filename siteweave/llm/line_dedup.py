"""Line dedup: runs of lines, removed where the same bytes occurred before.

A line (texts are split at \\n) is removed when it lies in a run of two or more lines whose bytes also occur as lines from an earlier
place on (smaller doc_id, or the same document further up). Chunks are the search for such runs, and ``pairs`` takes the finest ones: at
every line a chunk of two, overlapping the next by a line. Each run of two lines or more is made of such chunks only, so whatever
surrounds a copy, none is missed; as the next chunk is compared by bytes as well, a hit is extended line by line to both sides as far as
an earlier text agrees. The first occurrence of a line is never removed.

``chunks`` gives coarser, disjoint chunks: a rolling hash over the last WINDOW line hashes ends a chunk where it is 0 modulo EVERY, so that
boundaries depend on nearby lines only and recover after insertions. With these only whole chunks that coincide are found.

Plan: (1) light rows (hashes, length, place) of all multi-line chunks are aggregated by hash, with partial aggregation
before the shuffle, so a chunk that a third of the rows share costs one row a task; (2) a Bloom filter of fixed
size lets the chunks of repeated hashes pass with their bytes, and they are grouped by the bytes themselves, which is the comparison; (3) the places to remove are
gathered per document and joined to the texts. AQE splits skewed sides of the joins. No cap on copies.

Defined results: null text counts as empty; an empty text is one empty line; repeated rows with one doc_id are
distinct documents only if their doc_id differs: equal (doc_id, text) rows are treated alike, and each gives a row; rows
with a null doc_id neither cause nor suffer removals. Removing leaves the other lines, joined by \\n.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import durable, free, in_filter, key_filter

#: Lines in the rolling window, and the modulus that sets the mean chunk.
WINDOW, EVERY = 2, 2
#: Rows of a batch that are worked through at a time.
ROWS = 500
_MIX = 0x9E3779B97F4A7C15
#: A rule that cuts a text into chunks: (first line, end line) of each, at most one from any line on.
Rule = Callable[[str | None], list[tuple[int, int]]]


def chunks(text: str | None) -> list[tuple[int, int]]:
    """(first line, end line) of the chunks of a text's lines."""
    hashes = [xxhash.xxh3_64_intdigest(x) for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]
    out, start = [], 0
    for i, h in enumerate(hashes):
        for k in range(1, WINDOW):
            h = (h * _MIX + (hashes[i - k] if i >= k else 0)) & 0xFFFFFFFFFFFFFFFF
        if i + 1 == len(hashes) or (i - start >= 1 and (h >> 32) % EVERY == 0):
            out.append((start, i + 1))
            start = i + 1
    return out


def pairs(text: str | None) -> list[tuple[int, int]]:
    """(first line, end line) of all two lines in a row."""
    return [(i, i + 2) for i in range((text or "").count("\n"))]


def _places(docs: DataFrame, rule: Rule, only: Broadcast | None = None) -> DataFrame:
    """doc_id, first line, 128-bit hash in two longs and length of every chunk of two lines or more; with ``only``, of those whose h1 passes that filter, with their bytes."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (whole.iloc[lo : lo + ROWS] for whole in batches for lo in range(0, len(whole), ROWS)):
            out = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                lines = (t or "").encode("utf-8", "surrogatepass").split(b"\n")
                for a, z in rule(t):
                    if z - a > 1:
                        body = b"\n".join(lines[a:z])
                        h = xxhash.xxh3_128_digest(body)
                        out.append((i, a, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), len(body), *(() if only is None else (body,))))
            got = pd.DataFrame(out, columns=["doc_id", "no", "h1", "h2", "size", *(() if only is None else ("body",))])
            yield got if only is None else got[in_filter(only.value, got["h1"].to_numpy(np.int64))]

    schema = "doc_id long, no int, h1 long, h2 long, size int" + ", body binary" * (only is not None)
    return docs.filter("doc_id is not null").select("doc_id", "text").mapInPandas(rows, schema)


def removals(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id and the first lines of its chunks that are copies of an earlier chunk."""
    place = F.struct("doc_id", "no")
    repeated = durable(_places(docs, rule).groupBy("h1", "h2", "size").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high").select("h1", "h2", "size"))
    only = docs.sparkSession.sparkContext.broadcast(key_filter(repeated.select("h1")))
    copies = durable(_places(docs, rule, only).join(repeated, ["h1", "h2", "size"]).select("h1", "h2", "doc_id", "no", "body"))
    first = durable(copies.groupBy("h1", "h2", "body").agg(F.min(place).alias("low")))  # written: a join of two plain exchanges can split a hot key
    later = copies.join(first, ["h1", "h2", "body"]).filter(place != F.col("low"))
    return later.groupBy("doc_id").agg(F.collect_set("no").alias("gone"))


def _with_removals(docs: DataFrame, rule: Rule) -> tuple[DataFrame, str]:
    """docs with the first lines of the chunks to remove, and the name of that column. Always a merge join: the removals grow with the corpus."""
    gone = free(docs, "gone")
    found = removals(docs, rule).select(F.col("doc_id").alias(free(docs, "found")), F.col("gone").alias(gone)).hint("merge")
    return docs.join(found, docs["doc_id"] == found[found.columns[0]], "left").select(*(docs[c] for c in docs.columns), found[gone]), gone


def _kept(text: str | None, gone: list[int] | None, rule: Rule) -> tuple[int, int, str]:
    lines, firsts = (text or "").split("\n"), set(gone if gone is not None else ())
    cut = {i for a, z in rule(text) if a in firsts for i in range(a, z)} if firsts else firsts
    keep = [x for i, x in enumerate(lines) if i not in cut] if cut else lines
    return len(lines), len(lines) - len(keep), "\n".join(keep)


def dedup_lines(docs: DataFrame, rule: Rule = chunks) -> DataFrame:
    """The documents, all columns kept, with the copies cut out of text; n_chars, where present, is the new length.

    A text without removals, null included, stays as it is.
    """
    joined, column = _with_removals(docs, rule)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            texts, gone = b.column("text").to_pylist(), b.column(column).to_pylist()
            new = [_kept(t, g, rule)[2] if g else t for t, g in zip(texts, gone, strict=True)]
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            cols["text"] = pa.array(new, b.schema.field("text").type)
            if "n_chars" in cols:
                old = cols["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([len(t) if g else o for t, g, o in zip(new, gone, old, strict=True)], b.schema.field("n_chars").type)
            del cols[column]
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return joined.mapInArrow(rows, docs.schema)


def digest(docs: DataFrame, rule: Rule = pairs) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of the remaining lines' UTF-8 bytes."""
    joined, _ = _with_removals(docs.select("doc_id", "text"), rule)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t, g in zip(b["doc_id"], b["text"], b["gone"], strict=True):
                n, cut, kept = _kept(t, g, rule)
                out.append((i, n, cut, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_lines", "n_removed", "kept_sha256"]).astype({"doc_id": "Int64"})

    return joined.mapInPandas(rows, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL of digest() by ``pairs``: both lines of each two that stand in the same order at an earlier place go."""
    return f"""
with d as (select row_number() over () as rn, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from {docs}),
l as (select rn, doc_id, unnest(ls) as line, unnest(range(len(ls))) as no from d),
pairs as (select *, lead(line) over (partition by rn order by no) as after from l),
copies as (select rn, no from (select rn, no, rank() over (partition by line, after order by doc_id, no) as k from pairs where after is not null and doc_id is not null) where k > 1),
gone as (select rn, no from copies union select rn, no + 1 from copies)
select l.doc_id, count(*)::bigint as n_lines, count(gone.no)::bigint as n_removed,
  sha256(coalesce(string_agg(l.line, chr(10) order by l.no) filter (gone.no is null), '')) as kept_sha256
from l left join gone on gone.rn = l.rn and gone.no = l.no group by l.rn, l.doc_id"""
