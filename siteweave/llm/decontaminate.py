"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A document is contaminated by an item when, on some diagonal, a window of WINDOW consecutive tokens
of the item and the same number of the document agree in at least PERCENT of the positions. An item
with fewer tokens, but at least SHORTEST, is one window of its own length; one with still fewer tokens must occur unaltered.
Such windows are found by fixed masks that ignore some token positions. The masks of each class of item lengths are lossless: however
the tolerated substitutions fall into a window, at least one mask lies on agreeing positions only. (A window of 11 or 12 tokens holds one
of 10 with as many substitutions or fewer.)

Plan: one scan of the documents; token hashes are made by array expressions, exploded, and their seeds looked up
in the item seeds by a hash join inside the same stage; what lies around a hit is cut out there and compared, so no document
text is shuffled. Only masks of lengths that the benchmark has are used. Only confirmed (document, item) pairs are aggregated. The item seeds
are broadcast only while their counted number is within MAX_BROADCAST_SEEDS; beyond, the seeds of both sides are shuffled by hash, and the
hits joined back to the documents.

Tokens: Unicode lower case, maximal runs of letters and digits. Defined results: null or empty text has
no tokens, so it is never contaminated; rows that share a doc_id (null included) share the verdict, and each gives a
row; items with null text or without tokens match nothing; further columns are ignored here and kept by
``drop_contaminated``. An empty benchmark marks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import durable, free

WINDOW, PERCENT, SHORTEST = 13, 80, 10
#: Fixed masks, as offsets of the positions that count; lossless for 2 substitutions in WINDOW and in SHORTEST tokens.
MASKS = ((0, 3, 4, 6, 8, 9), (0, 1, 3, 6, 7, 8))
SHORT_MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 1, 4, 5, 6))
MAX_BROADCAST_SEEDS = 200_000
Masks = tuple[tuple[int, ...], ...]


def masks_of(n: int) -> Masks:
    """The masks for items of n tokens: under SHORTEST the whole item."""
    return MASKS if n >= WINDOW else SHORT_MASKS if n >= SHORTEST else (tuple(range(n)),) if n else ()


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _hashed(df: DataFrame, text: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.transform(tokens(F.col(text)), lambda t: F.xxhash64(t)).alias("h"))


def _exploded(df: DataFrame, masks: Masks, *keep: str) -> DataFrame:
    """A row for each mask and each position of the token hashes h where it fits: at, seed.

    One range of slots holds the positions of the masks one after the other. Slots are exploded and seeds computed after that, so
    that both stay in generated code up to the join.
    """
    fits = [F.greatest(F.size("h") - offsets[-1], F.lit(0)) for offsets in masks]
    total = sum(fits[1:], fits[0])
    rows = df.withColumn("slot", F.explode(F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))))
    begins = [sum(fits[1:m], fits[0]) if m else F.lit(0) for m in range(len(masks))]
    at, seed = F.col("slot"), None
    for m, begin in enumerate(begins[1:], 1):
        at = F.when(F.col("slot") >= begin, F.col("slot") - begin).otherwise(at)
    rows = rows.withColumn("at", at)
    for m, offsets in enumerate(masks):
        own = F.xxhash64(F.lit(",".join(map(str, offsets))), *(F.get(F.col("h"), F.col("at") + o) for o in offsets))
        seed = own if seed is None else F.when(F.col("slot") >= begins[m], own).otherwise(seed)
    return rows.select(*keep, "at", seed.alias("seed"))


def item_seeds(benchmark: DataFrame) -> tuple[DataFrame, Masks]:
    """seed, item_id, q (token position), n (tokens of the item), around (token hashes up to a window either side); and all masks in use.

    The lengths of short items, at most WINDOW of them, come to the driver.
    """
    items = _hashed(benchmark.filter(F.col("text").isNotNull()), "text", "item_id").filter(F.size("h") > 0)
    lengths = sorted(r[0] for r in items.select(F.least(F.size("h"), F.lit(WINDOW))).distinct().collect())
    classes: dict[Masks, list[int]] = {}
    for n in lengths:
        classes.setdefault(masks_of(n), []).append(n)
    first = F.greatest(F.col("at") - (WINDOW - 1), F.lit(0))
    rows = None
    for masks, own in (classes or {MASKS: [WINDOW]}).items():
        of = items.filter(F.least(F.size("h"), F.lit(WINDOW)).isin(own))
        some = _exploded(of, masks, "item_id", "h").select("seed", "item_id", F.col("at").alias("q"), F.size("h").alias("n"), first.alias("first"), F.slice("h", first + 1, F.lit(2 * WINDOW)).alias("around"))
        rows = some if rows is None else rows.union(some)
    return rows, tuple(m for masks in classes or [MASKS] for m in masks)


def _agrees() -> Column:
    """Whether a window of the item that holds the hit q agrees with the document (near, from its place shift on) on the hit's diagonal."""
    w = F.least(F.lit(WINDOW), F.col("n"))
    same = F.transform("around", lambda x, i: F.when(F.get(F.col("near"), i - F.col("shift")) == x, 1).otherwise(0))
    lowest = F.greatest(F.col("q") - (w - 1), F.lit(0))
    starts = F.sequence(lowest, F.greatest(F.least(F.col("q"), F.col("n") - w), lowest))
    percent = F.when(F.col("n") < SHORTEST, 100).otherwise(PERCENT)
    return F.exists(starts, lambda s: F.aggregate(F.slice(same, s - F.col("first") + 1, w), F.lit(0), lambda a, b: a + b) * 100 >= w * percent)


def matches(docs: DataFrame, benchmark: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """Distinct (doc_key, item_id) of confirmed overlaps."""
    items, masks = item_seeds(benchmark)
    hashed = _hashed(docs, "text", doc_key)
    if items.limit(MAX_BROADCAST_SEEDS + 1).count() <= MAX_BROADCAST_SEEDS:
        hits = _exploded(hashed, masks, doc_key, "h").join(F.broadcast(items), "seed")
    else:  # seeds without texts are shuffled, and the documents once more for the hits
        found = _exploded(hashed, masks, doc_key).join(items.hint("shuffle_hash"), "seed").withColumnRenamed(doc_key, "hit_key")
        hits = found.join(hashed, hashed[doc_key].eqNullSafe(found["hit_key"]))
    # of the document only what lies around a hit leaves the join, and the comparison stays out of its condition: a condition
    # that is not generated code would copy the whole document for every position
    start = F.col("at") - F.col("q") + F.col("first")
    near = hits.select(doc_key, "item_id", "q", "n", "first", "around", F.greatest(-start, F.lit(0)).alias("shift"), F.slice("h", F.greatest(start, F.lit(0)) + 1, F.lit(2 * WINDOW)).alias("near"))
    return near.groupBy(doc_key, "item_id").agg(F.bool_or(_agrees()).alias("agrees")).filter("agrees").select(doc_key, "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items long, item_ids (sorted)."""
    found = matches(docs, benchmark).groupBy(F.col("doc_id").alias("found_id")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    joined = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return joined.select("doc_id", (F.size(ids) > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns kept, without the contaminated ones."""
    bad = durable(matches(docs, benchmark).select(F.col("doc_id").alias(free(docs, "found"))).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[bad.columns[0]]), "left_anti")


def oracle(docs: str = "documents", benchmark: str = "benchmark") -> str:
    """DuckDB SQL of decontaminate() without masks.

    A window with two substitutions has somewhere a third of its other tokens in a row: 4 of 13, 3 of 10. Such runs of the items, and whole
    items under SHORTEST tokens, are looked for, and all windows around them compared.
    """
    toks = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
    size = f"case when len(h) >= {WINDOW} then {-(-(WINDOW - 2) // 3)} when len(h) >= {SHORTEST} then {-(-(SHORTEST - 2) // 3)} else len(h) end"
    runs = "list_transform(range(1, greatest(len(h) - k + 1, 0) + 1), lambda i: {'at': i - 1, 'seed': array_to_string(h[i:i + k - 1], ' ')})"
    return f"""
with d as (select doc_id, {toks} as h from {docs}),
b as (select item_id, h, {size} as k, least({WINDOW}, len(h)) as w, case when len(h) < {SHORTEST} then 100 else {PERCENT} end as percent
  from (select item_id, {toks} as h from {benchmark} where text is not null) where len(h) > 0),
ds as (select doc_id, h, k, unnest({runs}) as s from d, (select distinct k from b)),
bs as (select *, unnest({runs}) as s from b),
hits as (select distinct ds.doc_id, bs.item_id, ds.s['at'] as p, bs.s['at'] as q, w, percent, ds.h as dh, bs.h as bh
  from ds join bs on ds.k = bs.k and ds.s['seed'] = bs.s['seed']),
good as (select distinct doc_id, item_id from (
    select *, unnest(range(greatest(q - w + 1, 0), least(q, len(bh) - w) + 1)) as st from hits)
  where 100 * list_sum(list_transform(range(0, w), lambda k: case when st + k + p - q >= 0 and bh[st + k + 1] = dh[st + k + p - q + 1] then 1 else 0 end)) >= percent * w)
select d.doc_id, count(g.item_id) > 0 as contaminated, count(g.item_id) as n_items,
  list_sort(coalesce(list(g.item_id) filter (g.item_id is not null), []::bigint[])) as item_ids
from (select doc_id, row_number() over () as rn from {docs}) d left join good g on d.doc_id is not distinct from g.doc_id group by d.rn, d.doc_id"""
