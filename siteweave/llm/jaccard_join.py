"""N-gram Jaccard join: word-shingle sets, globally ordered, joined in prefix trees; components of the links.

Two documents link when 100 * |intersection| >= percent * |union|. Without caps on partners:

1. ``order_counts``: the shingles of all texts are counted, in SLOTS counters. (count, hash) is the global order of shingles, frequent ones last. Any
   order gives the same links; this one keeps frequent shingles out of prefixes.
2. ``passing``: sets that link share at least q shingles among the first n - ceil(percent * n / 100) + q of either. Rows (shingle, set) of these prefixes
   are dealt by shingle, sorted and scanned in a stream; a set with fewer than q shared shingles leaves, as most do. q is a
   quarter of the tolerated difference (at least 1), taken for the smallest partner a set can have.
3. ``neighbourhoods``: the rows of the remaining sets are scanned once more. The least set of a shingle is its hub, and all sets with a shingle of that hub are
   its neighbourhood, so sets that link have a neighbourhood in common. No closure is built before links are verified.
4. ``links``: the sets of a neighbourhood form a prefix tree, the most frequent shingles of its sets first; each set walks it once, sharing the
   overlap of shared prefixes and leaving subtrees whose sizes and remaining lengths can't reach the threshold or that are linked already.
   A neighbourhood beyond BLOCK_SETS or BLOCK_SHINGLES is split into blocks by set, the hub being in each. These links mostly make it one component;
   the sets outside its largest component are then joined with all its blocks. So the work grows with the square only where the sets share
   prefixes without being linked. ``components`` joins the links of all neighbourhoods.

Sets are told apart by 63-bit signatures, shingles by 64-bit hashes; they are not compared word by word.

Plan: rows are plain columns and partitions follow the counted bytes of text, so the cost of a byte does not depend on their number. Broadcast are the
counters (fixed size) and a Bloom filter of fixed size, which lets more sets through as it fills and never loses one.

Defined results: null or empty text has no shingles, links with nothing, and is its own component. Repeated rows with one doc_id give a
row each; rows with a null doc_id give as component_id the smallest non-null doc_id of the component, or null. Other columns are
ignored here and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.llm.bytehash import U, forest, mix, pieces, shingle_sets
from siteweave.llm.common import LOWER, UPPER, durable, free, in_filter, key_filter, partitions, text_bytes
from siteweave.llm.components import components

#: Most sets and shingles of a block.
BLOCK_SETS, BLOCK_SHINGLES = 500, 1_000_000
#: Counters of the order, and how many of them are summed as one row.
SLOTS, SLOT_RUN = 1 << 21, 1 << 10


def signature(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        h = mix(np.array([mix(s).sum(dtype=U) * U(0x9E3779B97F4A7C15) + U(len(s))], U))
    return int(h[0] >> U(1))


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """A few rows at a time with the shingle sets of their texts."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            b = whole.slice(lo, 256)
            yield b, [s for _, run in pieces(b.column("text").to_pylist()) for s in shingle_sets(run, words)]


def _packed_runs(runs: list[int], n: list[np.ndarray]) -> pa.RecordBatch:
    """(run, n): runs of counters as bytes, in the narrowest type that holds the largest."""
    packed = [x.astype(np.min_scalar_type(x.max())).tobytes() for x in n]
    return pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(packed, pa.binary())], ["run", "n"])


def _counters(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // SLOT_RUN}").astype(np.int64)


def order_counts(docs: DataFrame, words: int, size: int) -> np.ndarray:
    """Counters of the shingles of all texts (size bytes); at most SLOTS / SLOT_RUN rows are collected."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for _, sets in _sets(batches, words):
            for s in sets:
                np.add.at(n, _slot(s), 1)
        runs = n.reshape(-1, SLOT_RUN)
        own = np.flatnonzero(runs.any(axis=1))
        yield _packed_runs(own.tolist(), list(runs[own]))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for run, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums[run] = sums.get(run, 0) + _counters(raw)
        yield _packed_runs(list(sums), list(sums.values()))

    parts = docs.select("text").mapInArrow(counted, "run long, n binary").repartition(partitions(docs.sparkSession, size), "run")
    out = np.zeros((SLOTS // SLOT_RUN, SLOT_RUN), np.uint32)
    for run, raw in parts.mapInArrow(summed, "run long, n binary").collect():
        out[run] = np.minimum(_counters(raw), 0xFFFFFFFF)
    return out.ravel()


def _slot(s: np.ndarray) -> np.ndarray:
    return (s & U(SLOTS - 1)).astype(np.int64)


def shared_least(n: int, percent: int) -> int:
    """q for sets of n shingles."""
    return max(1, (100 - percent) * n // 200)


def prefix(s: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set's prefix in the global order."""
    size = len(s) - (percent * len(s) + 99) // 100 + shared_least(len(s), percent)
    if size >= len(s):
        return s
    return s[np.lexsort((s, counts[_slot(s)]))[:size]]


_PAIRS = pa.schema([("shingle", pa.int64()), ("sig", pa.int64()), ("n", pa.int64())])


def _pairs(sigs: list[int], sizes: list[int], prefixes: list[np.ndarray]) -> pa.RecordBatch:
    each = [len(p) for p in prefixes]
    flat = np.concatenate([np.empty(0, U), *prefixes]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(sigs, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int64), each))], schema=_PAIRS)


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (shingle, sig): (sig, n, hub) for the sets of each shingle that has several, the hub being its least."""
    held: tuple[tuple[int, int, int], tuple[int, int, int]] | None = None  # first and last row of the shingle that the rows before ended in
    alone = False  # whether that shingle has no other set than its hub so far
    for b in batches:
        shingle, sig, n = (c.to_numpy() for c in b.columns)
        if not len(shingle):
            continue
        carried = held is not None
        if held is not None:
            shingle, sig, n = (np.concatenate([[x, y], own]) for x, y, own in zip(*held, (shingle, sig, n), strict=True))
        new = np.append(True, shingle[1:] != shingle[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        other = ~new & np.append(False, sig[1:] != sig[:-1])
        several = np.zeros(len(new), bool)
        several[head[other]] = True
        first = new & several
        if carried:
            other[:2] = False
            first[0] = alone and several[0]
        rows = np.concatenate([np.flatnonzero(other), np.flatnonzero(first)])
        yield pa.RecordBatch.from_arrays([pa.array(sig[rows]), pa.array(n[rows]), pa.array(sig[head[rows]])], ["sig", "n", "hub"])
        last = head[-1]
        alone = not several[last] and (alone or last > 0 or not carried)
        held = tuple((int(shingle[i]), int(sig[i]), int(n[i])) for i in (last, -1))


def _scanned(rows: DataFrame, partitions_: int) -> DataFrame:
    return rows.repartition(partitions_, "shingle").sortWithinPartitions("shingle", "sig").mapInArrow(_hubs, "sig long, n long, hub long")


def passing(docs: DataFrame, words: int, percent: int, counts: Broadcast, partitions_: int) -> DataFrame:
    """(sig) of the sets of docs(text) whose prefix has enough shingles of other prefixes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches, words):
            own = {sig: s for s in sets if len(s) and (sig := signature(s)) not in seen}
            seen.update(own)
            yield _pairs(list(own), [len(s) for s in own.values()], [prefix(s, counts.value, percent) for s in own.values()])
            if len(seen) > 1_000_000:
                seen.clear()

    shared = _scanned(docs.select("text").mapInArrow(rows, "shingle long, sig long, n long"), partitions_).groupBy("sig").agg(F.count("*").alias("shared"), F.min("n").alias("n"))
    return durable(shared.filter(F.col("shared") >= _shared_with_smallest(percent)).select("sig"))


def _shared_with_smallest(percent: int) -> Column:
    """q for the smallest partner of sets of n shingles."""
    smallest = F.ceil(F.col("n") * percent / 100)
    return F.greatest(F.lit(1), F.floor(smallest * (100 - percent) / 200))


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (shingles) and sig of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.int64())], ["doc_id", "n", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n long, sig long")


def _chosen(batches: Iterator[pa.RecordBatch], words: int, only: np.ndarray) -> Iterator[dict[int, np.ndarray]]:
    """By signature the sets that pass the filter, once a task. Made again wherever they are used: the sets are larger than the texts."""
    seen: set[int] = set()
    for _, sets in _sets(batches, words):
        sigs = [signature(s) for s in sets]
        own = {sig: s for s, sig, ok in zip(sets, sigs, in_filter(only, np.array(sigs, np.int64)).tolist(), strict=True) if ok and len(s) and sig not in seen}
        seen.update(own)
        yield own


def chosen_sets(docs: DataFrame, words: int, only: Broadcast) -> DataFrame:
    """sig and shingles (packed) of the sets that pass the filter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _chosen(batches, words, only.value):
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([s.tobytes() for s in own.values()], pa.binary())], ["sig", "shingles"])

    return docs.select("text").mapInArrow(rows, "sig long, shingles binary")


def chosen_prefixes(docs: DataFrame, words: int, percent: int, counts: Broadcast, only: Broadcast) -> DataFrame:
    """shingle, sig, n: the prefixes of the sets that pass the filter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _chosen(batches, words, only.value):
            yield _pairs(list(own), [len(s) for s in own.values()], [prefix(s, counts.value, percent) for s in own.values()])

    return docs.select("text").mapInArrow(rows, "shingle long, sig long, n long")


def neighbourhoods(prefixes: DataFrame, percent: int, partitions_: int) -> DataFrame:
    """(sig, n, hub): the neighbourhoods of several sets that the sets of prefixes(shingle, sig, n) belong to."""
    counted = _scanned(prefixes, partitions_).groupBy("sig", "n", "hub").count()
    few_first = Window.partitionBy("sig").orderBy("count", "hub").rowsBetween(Window.unboundedPreceding, 0)
    kept = durable(counted.withColumn("sum", F.sum("count").over(few_first)).filter(2 * F.col("sum") >= _shared_with_smallest(percent)).select("sig", "n", "hub"))
    several = kept.groupBy("hub").count().filter("count > 1").select("hub")
    return durable(kept.join(several, "hub", "left_semi"))


class _Node:
    """A joined run of tokens below a parent; first and high: range of the sets below; here: sets that end with the run."""

    __slots__ = ("children", "end", "first", "here", "high", "longest", "run", "shortest")

    def __init__(self, sets: list[np.ndarray], first: int, high: int, depth: int):
        lo, hi = sets[first], sets[high]
        n = min(len(lo), len(hi))
        differ = np.flatnonzero(lo[depth:n] != hi[depth:n])
        self.end = depth + int(differ[0]) if len(differ) else n
        self.run, self.first, self.high, self.children = lo[depth : self.end], first, high, []
        self.here = [i for i in range(first, min(first + 1, high) + 1) if len(sets[i]) == self.end][:1]  # sets are distinct
        sizes = [len(x) for x in sets[first : high + 1]]
        self.shortest, self.longest = min(sizes), max(sizes)


def _tree(sets: list[np.ndarray]) -> _Node:
    """Prefix tree over lexicographically sorted distinct sets."""
    top = _Node(sets, 0, len(sets) - 1, 0)
    todo = [top]
    while todo:
        node = todo.pop()
        a = node.first + len(node.here)
        while a <= node.high:
            token, lo, hi, step = sets[a][node.end], a, a + 1, 1
            while hi <= node.high and sets[hi][node.end] == token:  # gallop past the end of the child's range
                lo, hi, step = hi, min(hi + step, node.high + 1), 2 * step
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if sets[mid][node.end] == token else (lo, mid)
            child = _Node(sets, a, lo, node.end)
            node.children.append(child)
            todo.append(child)
            a = lo + 1
    return top


def tree_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that span the components of the given distinct sets (any tokens)."""
    if len(sets) < 2:
        return []
    every, inv = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.empty(len(every), np.int64)
    rank[np.argsort(-np.bincount(inv), kind="stable")] = np.arange(len(every))
    cut = np.cumsum([0] + [len(s) for s in sets])
    ranked = [np.sort(rank[inv[a:z]]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
    order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes())
    ranked = [ranked[i] for i in order]
    top = _tree(ranked)
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, both = [], 100 + percent
    marked = np.zeros(len(every), np.uint8)
    for i, s in enumerate(ranked):
        size = len(s)
        marked[s] = 1
        stack = [(top, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.high <= i or 100 * node.longest < percent * size or 100 * size < percent * node.shortest:
                continue
            overlap += int(np.count_nonzero(marked[node.run]))
            if both * (overlap + min(node.longest - node.end, size - overlap)) < percent * (size + node.shortest):
                continue
            for j in node.here:
                if j > i and both * overlap >= percent * (size + node.end) and (a := find(i)) != (b := find(j)):
                    parent[max(a, b)] = min(a, b)
                    out.append((order[i], order[j]))
            for child in node.children:
                if child.first < child.high or find(child.first) != find(i):  # else it is one set, linked already
                    stack.append((child, overlap))
        marked[s] = 0
    return out


def _cell_links(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links inside each cell of rows (hub, one, two, sig, shingles) that come cell by cell; one cell is held at a time."""

    def cell(sets: dict[int, np.ndarray]) -> list[np.ndarray]:
        sigs = np.array(list(sets), np.int64)
        a, z = np.array(tree_links(list(sets.values()), percent), int).reshape(-1, 2).T
        return list(forest(sigs[a], sigs[z]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, {}, [[np.empty(0, np.int64)] * 2]
        for b in batches:
            for *own, sig, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != key:
                    if len(held) > 1:
                        out.append(cell(held))
                    key, held = own, {}
                held[sig] = np.frombuffer(s, U)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["src", "dst"])
            out = [[np.empty(0, np.int64)] * 2]
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cell(held)], ["src", "dst"])

    return rows


def _cells(members: DataFrame, sets: DataFrame, percent: int, partitions_: int) -> DataFrame:
    """(src, dst): links inside the cells of members(hub, one, two, sig)."""
    rows = members.join(sets, "sig").select("hub", "one", "two", "sig", "shingles")
    return durable(rows.repartition(partitions_, "hub", "one", "two").sortWithinPartitions("hub", "one", "two").mapInArrow(_cell_links(percent), "src long, dst long"))


def links(sets: DataFrame, members: DataFrame, percent: int, partitions_: int) -> DataFrame:
    """(src, dst) signatures: links that span the components of sets(sig, shingles), found in the neighbourhoods members(sig, n, hub)."""
    sets = sets.dropDuplicates(["sig"])
    sizes = members.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("k"))
    big = durable(sizes.filter("k > 1"))
    several = members.join(big, "hub", "left").select("sig", "hub", F.coalesce("k", F.lit(1)).alias("k"))
    block = F.pmod(F.xxhash64("sig"), "k").cast("int")
    every = F.explode(F.when(F.col("sig") == F.col("hub"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(block)))
    found = _cells(several.select("hub", every.alias("one"), F.lit(0).alias("two"), "sig"), sets, percent, partitions_)
    if big.isEmpty():
        return components(found)
    # of large neighbourhoods: what their blocks leave outside the largest component is joined with all of them
    labels = components(found).toDF("sig", "low")
    labelled = durable(members.join(big, "hub").join(labels, "sig", "left").select("sig", "hub", "k", F.coalesce("low", "sig").alias("label")))
    largest = labelled.groupBy("hub", "label").count().groupBy("hub").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rest = durable(labelled.join(durable(largest), "hub").filter("label <> main").select("sig", "hub", "k"))
    parts = durable(rest.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("parts")))
    all_ = labelled.join(parts, "hub").select("hub", block.alias("one"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("two"), "sig")
    few = rest.join(parts, "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("one"), F.pmod(F.xxhash64("sig"), "parts").cast("int").alias("two"), "sig")
    return components(found.union(_cells(all_.union(few).distinct(), sets, percent, partitions_)))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    context, size = docs.sparkSession.sparkContext, text_bytes(docs)
    n = partitions(docs.sparkSession, size)
    counts = context.broadcast(order_counts(docs, words, size))
    only = context.broadcast(key_filter(passing(docs, words, percent, counts, n)))
    rows = durable(signed(docs, words))
    members = neighbourhoods(chosen_prefixes(docs, words, percent, counts, only), percent, n)
    found = links(chosen_sets(docs, words, only), members, percent, n)
    keyed = rows.filter("n > 0").select("doc_id", "n", "sig").join(found.toDF("sig", "low"), "sig", "left").select("doc_id", "n", F.coalesce("low", "sig").alias("key"))
    lowest = durable(keyed.groupBy("key").agg(F.min("doc_id").alias("component_id")))  # written: a join of two plain exchanges can split a hot key
    some = keyed.join(lowest, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.union(rows.filter("n = 0").select("doc_id", "n", "doc_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns kept, of which each component leaves the one of the smallest doc_id."""
    gone = durable(near_duplicates(docs, words, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias(free(docs, "gone"))).distinct())
    return docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")


def oracle(words: int, percent: int, docs: str = "documents") -> str:
    """DuckDB SQL of near_duplicates(); pairs come from shared shingles, components from a recursive closure over distinct sets."""
    return f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as ws from {docs}),
s as (select doc_id, list_sort(list_distinct(case when len(ws) = 0 then []::varchar[] when len(ws) < {words} then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - {words - 2}), lambda i: array_to_string(ws[i:i + {words - 1}], ' ')) end)) as g from w),
n as (select g, len(g) as size, min(doc_id) as id from s group by g),
t as (select id, size, unnest(g) as x from n),
p as (select a.id as i, b.id as j from t a join t b on a.x = b.x and a.id < b.id and 100 * a.size >= {percent} * b.size and 100 * b.size >= {percent} * a.size
  group by a.id, b.id, a.size, b.size having {100 + percent} * count(*) >= {percent} * (a.size + b.size)),
e as (select i, j from p union all select j, i from p),
r(i, j) as (select id, id from n where size > 0 union select r.i, e.j from r join e on r.j = e.i),
c as (select i, min(j) as low from r group by i)
select s.doc_id, len(s.g) as n_shingles, coalesce(c.low, s.doc_id) as component_id
from s join n on s.g = n.g left join c on c.i = n.id"""
