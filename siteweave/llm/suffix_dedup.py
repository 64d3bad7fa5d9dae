"""Exact substring dedup: bytes covered by a LENGTH-byte string that also starts earlier, by prefix doubling over sampled starts.

The rank of a start at length h names the class of equal h-byte strings that begin there. Spark sorts (rank, position) rows, starts of unique
rank leave, and the others are ranked again by the pair of their ranks at a growing offset (h + offset bytes), until they are unique or h has
reached LENGTH. Names are fingerprints, so a pair is named without another sort, and three things keep the rows few:

* Sampled starts: of every LENGTH-byte string that is left, only its h-gram of least name (the leftmost of equals) is sorted: equal strings have
  it at equal offsets. Strings with one such gram are consecutive starts, a run, which is one row.
* A row also has the name of its whole run. Runs of equal rank and name are equal in all their strings: all but the first are settled at once
  (each string starts earlier in the first). First runs leave if their rank has no other run, else they go on to the next length.
* At h = LENGTH each start is its own run, so nothing is left open: a first start that shares its rank with other names (ranks have 40 bits
  and collide) stays as it is.

Plan of a round: tasks send a plain row per run, the copies that they see themselves settled before; rows are dealt by rank, sorted, and
scanned in a stream that holds one row. Partitions follow the counted bytes of text, and the rows of a byte don't depend on their number. Ranks that
a sample of SAMPLE_BYTES shows to be frequent are dealt by their runs' names over several partitions (their first runs simply stay open). The
answers are gathered by document and joined to the compressed texts; documents with open runs are written to the shared folder for the next
round. Nothing is broadcast but the frequent ranks of the sample. Long texts are worked through in pieces, so a task holds arrays of a piece only.

Classes are identified by rank and name (104 bits; modulo 2**64 with random byte values, mixed), at the last length by 64 + 40 bits of the string itself.
They are not compared byte by byte.

Defined results: null text counts as empty; texts under LENGTH bytes lose nothing; rows of equal doc_id and text are one document (each
gives a row); rows of equal doc_id but other text are ordered by a hash of the text (20 bits); rows with a null doc_id come after all others (above
2**63 - 2**56), in the order of a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.bytehash import BASE, BYTE, INVERSE, U, mix, powers
from siteweave.llm.common import durable, partitions, text_bytes

LENGTH = 100
#: Lengths of the rounds, as shares of LENGTH; each is at most twice the one before.
ROUNDS = (0.5, 0.75, 1.0)
#: Bytes in a piece of text (with the index of a byte in INDEX bits), runs in a task's memory, bytes of the sample, occurrences in the sample that make a rank frequent.
PIECE_BYTES, INDEX, FLUSH_RUNS, SAMPLE_BYTES, FREQUENT = 1 << 18, 20, 150_000, 1 << 24, 8
#: Rows and bytes of an Arrow batch that a task holds as Python objects; a row of more bytes stands alone.
SLICE_ROWS, SLICE_BYTES = 128, 1 << 22
#: Ranks have RANK bits; above them a frequent rank, dealt by name, and a row that is settled already, dealt by document.
RANK = 40
SPLIT, SETTLED = 1 << RANK, 1 << (RANK + 1)
#: A place is 20 bits of the text's hash, 31 bits of the run's first start and 12 bits of its last start less the first.
SPAN, START = 12, 31
#: Adjacent settled runs of a task are joined up to about so many starts.
JOINED = 3000
NULL_IDS = (1 << 63) - (1 << 56)
#: Greatest length, so that a run's starts fit in a place.
LONGEST = 1000


class Runs:
    """Runs of the starts of a text that lie in the given ranges: anchor, first and last start, rank of the anchor and name of the run."""

    def __init__(self, texts: list[bytes], offsets: list[int], open_: list[np.ndarray], h: int, length: int):
        """texts are pieces that begin at the offsets; open_ has the pieces' ranges of starts (first, last), counted from the pieces' begins."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        n, sizes = len(raw), np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.cumsum(sizes) - sizes
        own = [np.arange(a + f, a + z + 1) for a, ranges in zip(at.tolist(), open_, strict=True) for f, z in ranges.tolist()]
        starts = np.concatenate([np.empty(0, np.int64), *own])
        self.text = self.first = self.last = np.empty(0, np.int64)
        self.rank = self.name = np.empty(0, U)
        if not len(starts):
            return
        total = np.zeros(n + 1, U)
        np.cumsum(BYTE[raw] * powers(BASE, n), out=total[1:])
        back = powers(INVERSE, n + 1)
        half = -(-h // 2)
        # the rank of h bytes is the pair of the ranks of half of them, here and further on
        short = mix((total[half:] - total[:-half]) * back[: n - half + 1])
        rank = mix(short[: n - h + 1] * U(0x9E3779B97F4A7C15) + short[h - half :])
        width, step = length - h + 1, 1
        least = (rank >> U(INDEX) << U(INDEX)) | np.arange(len(rank), dtype=U)
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        chosen = (least[starts] & U((1 << INDEX) - 1)).astype(np.int64)
        new = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)))
        first, last, spot = starts[new], starts[np.append(new[1:] - 1, len(starts) - 1)], chosen[new]
        whole = mix((total[last + length] - total[first]) * back[first])
        self.name = mix(whole + (last - spot).astype(U) * U(0xA24BAED4963EE407) + (spot - first).astype(U) * U(0x9E3779B97F4A7C15))
        self.rank = mix(rank[spot]) >> U(64 - RANK)  # least names crowd near 0: mixed again, they spread
        self.text = np.searchsorted(at, first, side="right") - 1  # an empty text shares its begin with the next one, which is the one that has bytes
        shift = (at - np.array(offsets, np.int64))[self.text]
        self.first, self.last = first - shift, last - shift


def _pieces(rows: Iterator[tuple[int, int, bytes, np.ndarray | None]], length: int) -> Iterator[tuple[list[int], list[int], list[bytes], list[int], list[np.ndarray]]]:
    """Of (id, hash, text, open ranges or None for all): lists of ids, hashes, pieces of text, their offsets and ranges, of about PIECE_BYTES together."""
    held: tuple[list, ...] = ([], [], [], [], [])
    size = 0
    for i, h, raw, ranges in rows:
        if ranges is None:
            ranges = np.array([[0, len(raw) - length]])
        for lo in range(0, len(raw) - length + 1, PIECE_BYTES):
            own = ranges[(ranges[:, 1] >= lo) & (ranges[:, 0] < lo + PIECE_BYTES)].clip(lo, lo + PIECE_BYTES - 1) - lo
            own[:, 1] = np.minimum(own[:, 1], len(raw) - length - lo)
            if len(own):
                piece = raw[lo : lo + PIECE_BYTES + length - 1]
                for column, x in zip(held, (i, h, piece, lo, own), strict=True):
                    column.append(x)
                size += len(piece)
                if size >= PIECE_BYTES:
                    yield held
                    held, size = ([], [], [], [], []), 0
    if size:
        yield held


_ROW = "rank long, name long, id long, place long"
_ROW_ARROW = pa.schema([(c, pa.int64()) for c in ("rank", "name", "id", "place")])
_ANSWER_ARROW = pa.schema([("id", pa.int64()), ("place", pa.int64()), ("open", pa.bool_())])


def _batch(columns: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)


def _joined(ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Settled runs with adjacent ones of a document put together."""
    if not len(ids):
        return ids, places
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    first, text = (places >> SPAN) & ((1 << START) - 1), places >> (SPAN + START)
    last = first + (places & ((1 << SPAN) - 1))
    begins = np.append(True, (ids[1:] != ids[:-1]) | (text[1:] != text[:-1]) | (first[1:] > last[:-1] + 1))
    whole = first[np.flatnonzero(begins)][np.cumsum(begins) - 1]
    begins |= np.append(False, (first - whole)[1:] // JOINED != (first - whole)[:-1] // JOINED)
    at = np.flatnonzero(begins)
    end = np.maximum.reduceat(last, at)
    return ids[at], places[at] >> SPAN << SPAN | (end - first[at])


def _sent(rank: np.ndarray, name: np.ndarray, ids: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Rows of a task's runs: the first of each class, and the others, settled, dealt by document."""
    if not len(rank):
        return _batch([rank] * 4, _ROW_ARROW)
    order = np.lexsort((places, ids, name, rank))
    rank, name, ids, places = rank[order], name[order], ids[order], places[order]
    begins = np.append(True, (rank[1:] != rank[:-1]) | (name[1:] != name[:-1]))
    head = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    other = (ids != ids[head]) | (places != places[head])  # a repeated row is the same place
    some, spots = _joined(ids[other], places[other])
    dealt = SETTLED | (mix(some.astype(U)) >> U(64 - RANK)).astype(np.int64)
    return _batch([np.concatenate([rank[begins], dealt]), np.concatenate([name[begins], np.zeros(len(some), np.int64)]), np.concatenate([ids[begins], some]), np.concatenate([places[begins], spots])], _ROW_ARROW)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of rows sorted by rank, name and place: settled runs, and open ones (firsts of a rank that has several)."""
    held: tuple[int, int, int, int] | None = None  # first row of the class that the rows before ended in
    lone: tuple[int, int] | None = None  # first row of the rank that they ended in, as long as it has a single class
    for b in batches:
        rank, name, ids, places = (c.to_numpy() for c in b.columns)
        k = int(np.searchsorted(rank, SETTLED))
        out = [(ids[k:], places[k:], np.zeros(len(rank) - k, bool))]
        if k:
            rank, name, ids, places = (x[:k] for x in (rank, name, ids, places))
            carried = held is not None
            if held is not None:
                rank, name, ids, places = (np.append(np.int64(y), x) for x, y in zip((rank, name, ids, places), held, strict=True))
            new_rank = np.append(True, rank[1:] != rank[:-1])
            new_class = new_rank | np.append(True, name[1:] != name[:-1])
            head = np.flatnonzero(new_class)[np.cumsum(new_class) - 1]
            other = (ids != ids[head]) | (places != places[head])
            group = np.cumsum(new_rank) - 1
            classes = np.bincount(group, weights=new_class)
            if carried and lone is None:
                classes[0] += 1  # the rank had several classes before
            several = (classes[group] > 1) | (rank >= SPLIT)
            first = new_class & several
            first[:carried] = False
            if carried and lone is not None and several[0]:
                out.append((np.array([lone[0]]), np.array([lone[1]]), np.array([True])))
            out += [(ids[other], places[other], np.zeros(int(other.sum()), bool)), (ids[first], places[first], np.ones(int(first.sum()), bool))]
            begin = int(np.flatnonzero(new_rank)[-1])
            if several[-1]:
                lone = None
            elif begin or not carried:
                lone = int(ids[begin]), int(places[begin])
            held = tuple(int(x[head[-1]]) for x in (rank, name, ids, places))
        yield _batch([np.concatenate(x) for x in zip(*out, strict=True)], _ANSWER_ARROW)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows of Arrow batches at a time."""
    for b in batches:
        lo = 0
        while lo < b.num_rows:
            part = b.slice(lo, SLICE_ROWS)
            while part.num_rows > 1 and part.nbytes > SLICE_BYTES:
                part = part.slice(0, part.num_rows // 2)
            yield part
            lo += part.num_rows


def _open_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, np.ndarray | None]]:
    unzip = zstandard.ZstdDecompressor()
    for b in (x.to_pydict() for x in _sliced(batches)):
        if "text" in b:
            for i, h, t in zip(b["id"], b["hash"], b["text"], strict=True):
                yield i, h, t or b"", None
        else:
            for i, h, p, o in zip(b["id"], b["hash"], b["packed"], b["open"], strict=True):
                yield i, h, unzip.decompress(p), np.frombuffer(o, np.int64).reshape(-1, 2)


def _ranked(h: int, length: int, split: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the open runs of texts, ranked by h bytes. split: number of parts that a frequent rank is dealt to."""
    frequent = np.array(sorted(split), np.int64)
    parts = np.array([split[x] for x in sorted(split)], np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for ids, hashes, texts, offsets, ranges in _pieces(_open_texts(batches), length):
            r = Runs(texts, offsets, ranges, h, length)
            rank, name = r.rank.astype(np.int64), r.name.view(np.int64)
            if len(frequent) and len(rank):
                at = np.minimum(np.searchsorted(frequent, rank), len(frequent) - 1)
                part = (r.name >> U(20)) % parts[at].astype(U)
                dealt = SPLIT | (mix(r.rank + part * U(1 << RANK) + U(1 << 63)) >> U(64 - RANK)).astype(np.int64)
                rank = np.where(frequent[at] == rank, dealt, rank)
            place = np.array(hashes, np.int64)[r.text] << (SPAN + START) | r.first << SPAN | (r.last - r.first)
            held.append((rank, name, np.array(ids, np.int64)[r.text], place))
            if sum(len(x[0]) for x in held) > FLUSH_RUNS:
                yield _sent(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
        if held:
            yield _sent(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows


def frequent_ranks(docs: DataFrame, size: int, n: int, h: int, length: int) -> dict[int, int]:
    """Ranks that are frequent in a sample of the documents, and the number of partitions of n that each should fill."""
    sample = docs.sample(min(1.0, SAMPLE_BYTES / max(1, size)), seed=7) if size > SAMPLE_BYTES else docs

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts, offsets, ranges in _pieces(_open_texts(batches), length):
            yield pa.RecordBatch.from_arrays([pa.array(Runs(texts, offsets, ranges, h, length).rank.astype(np.int64))], ["rank"])

    counted = sample.mapInArrow(ranks, "rank long").groupBy("rank").count()
    total = size / min(1.0, max(1, size) / SAMPLE_BYTES) * 2 / (length - h + 2)  # expected runs in the sample
    most = max(FREQUENT, total / (4 * n))
    return {r["rank"]: 1 + int(4 * n * r["count"] / max(1.0, total)) for r in counted.filter(F.col("count") >= most).collect()}


def _cover(ranges: np.ndarray) -> np.ndarray:
    """Maximal ranges (first, end) that cover the given ones; adjacent ones are joined."""
    if len(ranges) < 2:
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    end = np.maximum.accumulate(ranges[:, 1])
    begins = np.append(True, ranges[1:, 0] > end[:-1])
    at = np.flatnonzero(begins)
    return np.stack([ranges[at, 0], np.append(end[at[1:] - 1], end[-1])], 1)


def _result(raw: bytes, ranges: np.ndarray) -> tuple[int, int, int, str]:
    kept, at = hashlib.sha256(), 0
    for a, z in ranges.tolist():
        kept.update(raw[at:a])
        at = z
    kept.update(raw[at:])
    return len(raw), int((ranges[:, 1] - ranges[:, 0]).sum()), len(ranges), kept.hexdigest()


RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
_STATE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, id long, hash long, packed binary, ranges binary, open binary"
_STATE_ARROW = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in _STATE.split(", ")])


def _advanced(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents with their answers: those without open runs get their result, the others the ranges known so far."""

    def spans(places: list[int] | None, more: int) -> np.ndarray:
        p = np.array(places or [], np.int64)
        first = (p >> SPAN) & ((1 << START) - 1)
        return _cover(np.stack([first, first + (p & ((1 << SPAN) - 1)) + more], 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in (x.to_pydict() for x in _sliced(batches)):
            out = []
            for doc_id, i, h, packed, old, gone, left in zip(*(b[c] for c in ("doc_id", "id", "hash", "packed", "ranges", "gone", "left")), strict=True):
                before = np.frombuffer(old or b"", np.int64).reshape(-1, 2)
                ranges = _cover(np.concatenate([before, spans(gone, length)]))
                if left:
                    # ranges of starts, as first and last one
                    out.append((doc_id, None, None, None, None, i, h, packed, ranges.tobytes(), (spans(left, 1) - [0, 1]).tobytes()))
                else:
                    out.append((doc_id, *_result(unzip.decompress(packed), ranges), i, h, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _STATE_ARROW, strict=True)], schema=_STATE_ARROW)

    return rows


def _identity() -> list[Column]:
    """id and hash of a document."""
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    null = F.lit(NULL_IDS) + h.bitwiseAND(F.lit((1 << 56) - 1))
    return [F.coalesce(F.col("doc_id").cast("long"), null).alias("id"), F.shiftrightunsigned(h, 44).alias("hash")]


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    if not 2 <= length <= LONGEST:
        raise ValueError(f"length {length} is not in 2 to {LONGEST}")
    size = text_bytes(docs)
    n = partitions(docs.sparkSession, size)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for part in _sliced(batches):
            texts = [z.compress(t or b"") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "id", "hash")), pa.array(texts, pa.binary()), pa.nulls(len(texts), pa.binary())], ["doc_id", "id", "hash", "packed", "ranges"])

    # as bytes: as Python strings, texts take up to four bytes a character
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_identity(), F.col("text").cast("binary").alias("text"))
    ranked_from = whole.select("id", "hash", "text")
    texts = whole.mapInArrow(packed, "doc_id long, id long, hash long, packed binary, ranges binary")
    done = None
    for share in ROUNDS:
        h = max(1, round(share * length))
        split = frequent_ranks(ranked_from, size, n, h, length) if done is None else {}
        rows = ranked_from.mapInArrow(_ranked(h, length, split), _ROW)
        answers = rows.repartition(n, "rank").sortWithinPartitions("rank", "name", "id", "place").mapInArrow(_scan, "id long, place long, open boolean")
        if share == ROUNDS[-1]:
            answers = answers.filter(~F.col("open"))  # colliding ranks: these strings differ
        placed = answers.select("id", F.shiftright("place", SPAN + START).alias("hash"), "place", "open").repartition(n, "id", "hash").groupBy("id", "hash")
        gathered = placed.agg(F.collect_list(F.when(~F.col("open"), F.col("place"))).alias("gone"), F.collect_list(F.when(F.col("open"), F.col("place"))).alias("left"))
        state = texts.repartition(n, "id", "hash").join(gathered.hint("merge"), ["id", "hash"], "left").select("doc_id", "id", "hash", "packed", "ranges", "gone", "left").mapInArrow(_advanced(length), _STATE)
        if share != ROUNDS[-1]:
            state = durable(state)
        some = state.filter("packed is null").select(*RESULT)
        done = some if done is None else done.union(some)
        pending = state.filter("packed is not null")
        ranked_from, texts = pending.select("id", "hash", "packed", "open"), pending.select("doc_id", "id", "hash", "packed", "ranges")
    return done


def oracle(length: int = LENGTH, docs: str = "documents") -> str:
    """DuckDB SQL of remove_repeats(): all strings of the length, the places after the first of each, and what they cover."""
    return f"""
with d as (select row_number() over () as rn, doc_id, coalesce(doc_id, 9223372036854775807) as id, encode(coalesce(text, '')) as b from {docs}),
u as (select row_number() over (order by id, md5(b)) as n, id, b from (select distinct id, b from d)),
x as (select n, id, s, b[s + 1:s + {length}] as x from (select n, id, b, unnest(range(0, greatest(octet_length(b) - {length - 1}, 0))) as s from u)),
late as (select n, s from (select n, s, row_number() over (partition by x order by id, n, s) as k from x) where k > 1),
marked as (select n, s, case when s > coalesce(lag(s) over (partition by n order by s) + {length}, -1) then 1 else 0 end as begins from late),
runs as (select n, min(s) as a, max(s) + {length} as z from (select n, s, sum(begins) over (partition by n order by s) as run from marked) group by n, run),
ends as (select n, a, z from runs union all select n, octet_length(b), octet_length(b) from u),
parts as (select e.n, e.a, u.b[coalesce(lag(e.z) over (partition by e.n order by e.a, e.z), 0) + 1:e.a] as part from ends e join u on u.n = e.n),
kept as (select n, sha256(unhex(string_agg(hex(part), '' order by a))) as kept_sha256 from parts group by n),
gone as (select n, sum(z - a)::bigint as n_removed, count(*) as n_spans from runs group by n)
select d.doc_id, octet_length(d.b)::bigint as n_bytes, coalesce(gone.n_removed, 0)::bigint as n_removed, coalesce(gone.n_spans, 0)::bigint as n_spans, kept.kept_sha256
from d join u on u.id = d.id and u.b = d.b join kept on kept.n = u.n left join gone on gone.n = u.n"""
