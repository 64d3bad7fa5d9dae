"""SentencePiece-style encoding and decoding with N-best segmentation over the piece lattice.

A text, with one space put in front, is a lattice of vocabulary pieces (``▁`` stands for a space in them) and, for characters
that no piece covers alone, of byte pieces. A piece costs the negative logarithm of a Zipf law of its rank in the vocabulary,
so a segmentation's score is a sum of log-probabilities. Forward Viterbi gives each lattice node the score of its best prefix;
these are exact heuristics for a backward A* search that takes the N best segmentations off the queue in order.

No piece holds a space after another character, or a line feed, so the lattice falls into independent segments (a word with the
spaces before it, a line feed). Segments are looked up in a per-worker cache; new ones go through a vectorised Viterbi that also
gives the gap to their second-best path. Only the N - 1 occurrences of least gap can differ from the best segmentation among
the N best of a text, so A* visits these alone and their alternatives are merged. A segment of any length costs time and memory in
proportion to it: every hypothesis that leaves the queue becomes a segmentation, also among equally good ones.

With each of the N best come the segments in which it differs from the best one and their piece ids, at most N - 1 of them; ``alternative`` puts
them in the place of the best segmentation's ids.

Plan: one pass with Arrow batches that encodes and decodes again, no shuffle; the vocabulary (a fixed file of at most MAX_PIECES) is broadcast.
Decoding is lossless: a literal ``▁`` is encoded as bytes. Defined results: null or empty text has no pieces and no scores;
a text with fewer than N segmentations has fewer scores; ties keep the longer last piece.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from siteweave.llm.bytehash import U, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_PIECES = 1_000_000
N_BEST = 4
SEGMENT = re.compile(r" *[^ \n]+| +|\n")
#: Segments up to this length are vectorised; the cache is emptied beyond so many.
VECTOR_CHARS, CACHED = 48, 400_000
#: Ids of best and of other segmentations beyond which the cache is emptied; long segments: starts in a block, and length up to which the edges are held.
CACHED_IDS, CACHED_OTHERS, BLOCK, HELD_CHARS = 10_000_000, 500_000, 1 << 18, 1 << 21
#: Scores are multiples of 1 / GRAIN.
GRAIN = 1 << 20
_CODE_BASE = 0xC6BC279692B5C323
_BITS = 20


def load(path: str = MODEL) -> tuple[list[str], list[int]]:
    """Pieces by id (byte pieces as '', controls as None-like '') and the ids of the 256 bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    if n > MAX_PIECES:
        raise ValueError(f"{n} pieces, more than {MAX_PIECES}")
    special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
    names = [sp.id_to_piece(i) for i in range(n)]
    return ["" if s else p.replace("▁", " ") for p, s in zip(names, special, strict=True)], [names.index(f"<0x{b:02X}>") for b in range(256)]


def outputs(pieces: list[str], bytes_: list[int]) -> list[bytes]:
    """The bytes that each id stands for."""
    out = [p.encode() for p in pieces]
    for b, i in enumerate(bytes_):
        out[i] = bytes([b])
    return out


def join(out: list[bytes], ids: list[int]) -> str:
    """The text of ids, without the space put in front."""
    return b"".join(map(out.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


class Encoder:
    def __init__(self, pieces: list[str], bytes_: list[int]):
        self.pieces, self.byte_ids = pieces, bytes_
        total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
        self.ids: dict[str, int] = {}
        self.logp = np.zeros(len(pieces))
        for r, (i, p) in enumerate((i, p) for i, p in enumerate(pieces) if p):
            self.ids.setdefault(p, i)
            self.logp[i] = -math.log(r + 1) - total
        # multiples of a power of two: sums are exact in any order, so equal scores are equal numbers
        self.logp = np.round(self.logp * GRAIN) / GRAIN
        self.byte_logp = float(self.logp.min()) - 10.0
        self.longest = max(map(len, self.ids))
        self.out = outputs(pieces, bytes_)
        self._table()
        self._clear()

    # -- scalar lattice -----------------------------------------------------------------------------------------------

    def edges(self, seg: str) -> list[list[tuple[int, int, float]]]:
        """Per end position: (start, piece id or -1 for bytes, score), longest first."""
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(seg) + 1)]
        for e in range(1, len(seg) + 1):
            for a in range(max(0, e - self.longest), e):
                i = self.ids.get(seg[a:e])
                if i is not None:
                    out[e].append((a, i, float(self.logp[i])))
            if not out[e] or out[e][-1][0] != e - 1:
                out[e].append((e - 1, -1, self.byte_logp * len(seg[e - 1].encode("utf-8", "surrogatepass"))))
        return out

    def n_best(self, seg: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations, best first: forward Viterbi, then backward A* with its exact heuristics.

        The best edge into a node leaves a hypothesis' estimate as it is, so a hypothesis that leaves the queue is followed along best edges
        to the start at once, and the other edges on its way join the queue. Each pop thus gives a segmentation, however many are equally good.
        """
        if len(seg) > VECTOR_CHARS:
            return self._n_best_long(seg, n)
        edges = self.edges(seg)
        ahead, came = [0.0] + [-math.inf] * len(seg), [(0, 0, 0.0)] * (len(seg) + 1)
        for e in range(1, len(seg) + 1):
            for edge in edges[e]:
                if ahead[edge[0]] + edge[2] > ahead[e]:
                    ahead[e], came[e] = ahead[edge[0]] + edge[2], edge
        queue: list[tuple[float, int, int, float, tuple | None]] = [(-ahead[-1], 0, len(seg), 0.0, None)]
        pushed, found = 0, []
        while queue and len(found) < n:
            _, _, e, behind, path = heapq.heappop(queue)
            while e:
                for edge in edges[e]:
                    if edge is not came[e]:
                        a, i, s = edge
                        pushed += 1
                        heapq.heappush(queue, (-(behind + s + ahead[a]), pushed, a, behind + s, ((a, e, i), path)))
                a, i, s = came[e]
                path, behind, e = ((a, e, i), path), behind + s, a
            ids: list[int] = []
            while path:
                (a, z, i), path = path
                ids += [i] if i >= 0 else [self.byte_ids[b] for b in seg[a:z].encode("utf-8", "surrogatepass")]
            found.append((behind, ids))
        return found

    def _blocks(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Edges of one long segment, BLOCK starts at a time, sorted by start: start, length, piece id or -1, score."""
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        for lo in range(0, len(codes), BLOCK):
            part = codes[lo : lo + BLOCK + self.longest - 1]
            total, alive = self._prefix_sums(part), np.arange(min(BLOCK, len(codes) - lo))
            bare, found = np.ones(len(alive), bool), []
            for k in range(1, self.longest + 1):
                alive = alive[alive + k <= len(part)]
                if not len(alive):
                    break
                got = self._look_up(self._code_hash(total, alive, k))
                alive, got = alive[got != -2], got[got != -2]
                real = got >= 0
                if k == 1:
                    bare[alive[real]] = False
                found.append((alive[real], np.full(int(real.sum()), k), got[real].astype(np.int64), self.logp[got[real]]))
            odd = np.flatnonzero(bare)
            found.append((odd, np.ones(len(odd), np.int64), np.full(len(odd), -1), self.byte_logp * width[lo + odd]))
            start, length, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((length, start))
            yield start[order] + lo, length[order], ids[order], score[order]

    def _n_best_long(self, seg: str, n: int) -> list[tuple[float, list[int]]]:
        """n_best() with the edges in arrays: memory and time grow with the length, and only n side edges of a hypothesis join the queue."""
        codes = np.frombuffer(seg.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = len(codes)
        kept = list(self._blocks(codes)) if size <= HELD_CHARS else None
        best, came = [0.0] + [-math.inf] * size, [0] * (size + 1)
        for block in kept or self._blocks(codes):
            for a, k, s in zip(block[0].tolist(), block[1].tolist(), block[3].tolist(), strict=True):
                if best[a] + s > best[a + k]:  # the first, i.e. longest, of equals stays
                    best[a + k], came[a + k] = best[a] + s, k
        ahead, back = np.array(best), np.array(came)
        queue: list[tuple[float, int, list[tuple[int, int]]]] = [(-best[-1], 0, [])]
        pushed, found = 0, []
        while queue and len(found) < n:
            cost, _, turns = heapq.heappop(queue)
            spans, e = [], size
            for end, start in [*turns, (0, 0)]:
                while e > end:
                    spans.append((e - came[e], e))
                    e -= came[e]
                if e:
                    spans.append((start, end))
                    e = start
            ids: list[int] = []
            for a, e in reversed(spans):
                i = self.ids.get(seg[a:e])
                ids += [i] if i is not None else [self.byte_ids[b] for b in seg[a:e].encode("utf-8", "surrogatepass")]
            found.append((-cost, ids))
            if len(found) == n:
                break
            on_path = np.zeros(size + 1, bool)
            free = turns[-1][1] if turns else size
            on_path[[e for _, e in spans if e <= free]] = True
            side: list[tuple[float, int, int]] = []
            for start, length, _, score in kept or self._blocks(codes):
                end = start + length
                own = np.flatnonzero(on_path[end] & (back[end] != length))
                loss = ahead[end[own]] - ahead[start[own]] - score[own]
                if len(own) > n:
                    few = np.argpartition(loss, n - 1)[:n]
                    own, loss = own[few], loss[few]
                side += zip(loss.tolist(), end[own].tolist(), start[own].tolist(), strict=True)
            for loss, end, start in heapq.nsmallest(n - len(found), side):
                pushed += 1
                heapq.heappush(queue, (cost + loss, pushed, [*turns, (end, start)]))
        return found

    # -- vectorised Viterbi over many segments ------------------------------------------------------------------------

    def _code_hash(self, total: np.ndarray, a: np.ndarray, n: int) -> np.ndarray:
        h = (total[a + n] - total[a]) * self._inverse[a]
        h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(32))

    def _prefix_sums(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        self._inverse = powers(pow(_CODE_BASE, -1, 1 << 64), n + 1)
        mixed = (codes.astype(U) + U(1)) * U(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> U(30)
        total = np.zeros(n + 1, U)
        np.cumsum(mixed * U(0x94D049BB133111EB) * powers(_CODE_BASE, n), out=total[1:])
        return total

    def _table(self) -> None:
        """Hash table of all pieces and their prefixes (id -1)."""
        entries: dict[str, int] = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                entries.setdefault(p[:k], -1)
            entries[p] = i
        keys = np.empty(len(entries), U)
        by_length: dict[int, list[tuple[int, str]]] = {}
        for at, p in enumerate(entries):
            by_length.setdefault(len(p), []).append((at, p))
        for n, group in by_length.items():
            codes = np.frombuffer("".join(p for _, p in group).encode("utf-32-le"), np.uint32)
            keys[[at for at, _ in group]] = self._code_hash(self._prefix_sums(codes), np.arange(len(group)) * n, n)
        ids = np.fromiter(entries.values(), np.int64, len(entries))
        order = np.argsort(keys >> U(64 - _BITS), kind="stable")
        self._keys, self._values = keys[order], ids[order].astype(np.int32)
        slots = (self._keys >> U(64 - _BITS)).astype(np.int64)
        self._slot = np.searchsorted(slots, np.arange((1 << _BITS) + 1)).astype(np.int32)
        self._probes = int(np.diff(self._slot).max())
        self._keys = np.append(self._keys, np.zeros(self._probes, U))
        self._values = np.append(self._values, np.full(self._probes, -2, np.int32))

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """Piece id, -1 for a mere prefix, -2 for neither."""
        at = self._slot[(h >> U(64 - _BITS)).astype(np.int64)]
        got = np.where(self._keys[at] == h, self._values[at], -2)
        for k in range(1, self._probes):
            miss = np.flatnonzero(got == -2)
            if not len(miss):
                break
            got[miss] = np.where(self._keys[at[miss] + k] == h[miss], self._values[at[miss] + k], -2)
        return got

    def _viterbi(self, segs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, number of ids, score and gap to the second best of each segment."""
        sizes = np.fromiter(map(len, segs), np.int64, len(segs))
        codes = np.frombuffer("".join(segs).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes)
        starts = np.cumsum(sizes) - sizes
        room = np.repeat(starts + sizes, sizes) - np.arange(n)
        total = self._prefix_sums(codes)
        depth = min(self.longest, int(sizes.max()))
        ids = np.full((depth + 1, n), -2, np.int32)
        score = np.full((depth + 1, n), -np.inf)
        alive = np.arange(n)
        for k in range(1, depth + 1):
            alive = alive[room[alive] >= k]
            if not len(alive):
                break
            got = self._look_up(self._code_hash(total, alive, k))
            alive, got = alive[got != -2], got[got != -2]
            real = got >= 0
            ids[k, alive[real]] = got[real]
            score[k, alive[real]] = self.logp[got[real]]
        bare = np.flatnonzero(ids[1] < 0)
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        ids[1, bare] = -1
        score[1, bare] = self.byte_logp * width[bare]
        # node p of a segment is at starts + index of the segment + p: one more node than characters
        node0 = starts + np.arange(len(segs))
        best, second = np.full(n + len(segs), -np.inf), np.full(n + len(segs), -np.inf)
        came = np.zeros(n + len(segs), np.int32)
        best[node0] = 0.0
        order = np.argsort(-sizes, kind="stable")
        left = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max()) + 1), side="right")
        for e in range(1, int(sizes.max()) + 1):
            own = order[: left[e - 1]]
            node, char = node0[own] + e, starts[own] + e
            b = s = np.full(len(own), -np.inf)
            length = np.zeros(len(own), np.int32)
            for k in range(1, min(depth, e) + 1):
                w = score[k, char - k]
                one, two = best[node - k] + w, second[node - k] + w
                s = np.maximum(np.maximum(s, two), np.minimum(b, one))
                longer = one >= b
                length = np.where(longer, k, length)
                b = np.where(longer, one, b)
            best[node], second[node], came[node] = b, s, length
        end = node0 + sizes
        chosen = np.zeros(n, np.int32)  # length of the piece that begins here
        at, shift = end.copy(), np.arange(len(segs))
        while len(at):
            k = came[at]
            at = at - k
            chosen[at - shift] = k
            more = at > node0[shift]
            at, shift = at[more], shift[more]
        begin = np.flatnonzero(chosen)
        flat = ids[chosen[begin], begin]
        count = np.where(flat >= 0, 1, width[begin])
        owner = np.searchsorted(starts, begin, side="right") - 1
        if (flat < 0).any():
            text = "".join(segs)
            parts = [[int(i)] if i >= 0 else [self.byte_ids[x] for x in text[p].encode("utf-8", "surrogatepass")] for i, p in zip(flat, begin, strict=True)]
            flat = np.array([i for p in parts for i in p], np.int32)
        gap = best[end] - second[end]
        return flat, np.bincount(owner, weights=count, minlength=len(segs)).astype(np.int64), best[end], gap

    # -- cache --------------------------------------------------------------------------------------------------------

    def _clear(self) -> None:
        self._known: dict[str, int] = {}
        self._flat, self._used = np.empty(1 << 20, np.int32), 0
        self._starts, self._counts = np.empty(CACHED * 2, np.int64), np.empty(CACHED * 2, np.int64)
        self._scores, self._gaps = np.empty(CACHED * 2), np.empty(CACHED * 2)
        self._alternatives: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}
        self._held = 0

    def _add(self, segs: list[str]) -> None:
        short = [s for s in segs if len(s) <= VECTOR_CHARS]
        for lo in range(0, len(short), 20_000):
            self._put(short[lo : lo + 20_000], *self._viterbi(short[lo : lo + 20_000]))
        for s in segs:
            if len(s) > VECTOR_CHARS:
                found = self._options(s, N_BEST)
                best = found[0]
                self._put([s], np.array(best[1], np.int32), np.array([len(best[1])]), np.array([best[0]]), np.array([best[0] - found[1][0] if len(found) > 1 else math.inf]))

    def _options(self, seg: str, n: int) -> list[tuple[float, list[int]]]:
        """n_best(), kept for the next time; long segments have many ids and are kept only until the cache is emptied."""
        got = self._alternatives.get((seg, n))
        if got is None:
            got = self._alternatives[seg, n] = self.n_best(seg, n)
            self._held += sum(len(i) for _, i in got)
        return got

    def _put(self, segs: list[str], flat: np.ndarray, count: np.ndarray, score: np.ndarray, gap: np.ndarray) -> None:
        a, z = len(self._known), len(self._known) + len(segs)
        while self._used + len(flat) > len(self._flat):
            self._flat = np.append(self._flat, np.empty(len(self._flat), np.int32))
        while z > len(self._starts):
            self._starts, self._counts, self._scores, self._gaps = (np.append(x, np.empty_like(x)) for x in (self._starts, self._counts, self._scores, self._gaps))
        self._flat[self._used : self._used + len(flat)] = flat
        self._starts[a:z] = self._used + np.cumsum(count) - count
        self._counts[a:z], self._scores[a:z], self._gaps[a:z] = count, score, gap
        self._known.update(zip(segs, range(a, z), strict=True))
        self._used += len(flat)

    # -- texts --------------------------------------------------------------------------------------------------------

    def encode_all(self, texts: list[str | None], n: int = N_BEST) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list[list[tuple[int, list[int]]]]]]:
        """Of many texts: all ids of the best segmentations, their number by text, the n best scores, and for each of these the segments that differ (number, ids)."""
        if len(self._known) > CACHED or self._used > CACHED_IDS:
            self._clear()
        if self._held > CACHED_OTHERS:
            self._alternatives, self._held = {}, 0
        known, segs, sizes = self._known, [], []
        for t in texts:
            own = SEGMENT.findall(f" {t}") if t else []
            segs += own
            sizes.append(len(own))
        new = set(segs).difference(known)
        if new:
            self._add(sorted(new))
        if not segs:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64), [[] for _ in texts], [[] for _ in texts]
        at = np.fromiter(map(known.__getitem__, segs), np.int64, len(segs))
        count, gaps, ends = self._counts[at], self._gaps[at], np.cumsum(self._counts[at])
        ids = self._flat[np.repeat(self._starts[at] - ends + count, count) + np.arange(ends[-1])]
        cut = np.cumsum([0, *sizes])
        total = np.append(0, ends)[cut]
        best = np.append(0.0, np.cumsum(self._scores[at]))[cut]  # exact: the scores are multiples of a power of two
        scores, changes = [], []
        for i, (a, z) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if a == z:
                scores.append([])
                changes.append([])
                continue
            own = gaps[a:z]
            near = np.sort(np.argpartition(own, n - 1)[: n - 1]).tolist() if z - a >= n else range(z - a)
            merged: list[tuple[float, list[tuple[int, list[int]]]]] = [(0.0, [])]
            for k in near:
                if own[k] < math.inf:
                    options = self._options(segs[a + k], n)
                    top, few = options[0][0], []
                    for d, e in merged:
                        few.append((d, e))
                        few += [(d + s - top, [*e, (k, i)]) for s, i in options[1:]]
                    few.sort(key=lambda x: -x[0])
                    merged = few[:n]
            base = float(best[i + 1] - best[i])
            scores.append([base + d for d, _ in merged])
            changes.append([e for _, e in merged])
        return ids, np.diff(total), scores, changes

    def encode(self, text: str | None, n: int = N_BEST) -> tuple[np.ndarray, list[float], list[list[tuple[int, list[int]]]]]:
        """Ids of the best segmentation, the n best scores, and for each of these the segments that differ (number, ids)."""
        ids, _, scores, changes = self.encode_all([text], n)
        return ids, scores[0], changes[0]

    def decode(self, ids: np.ndarray) -> str:
        return join(self.out, ids.tolist())

    def alternative(self, ids: list[int], changes: list[tuple[int, list[int]]]) -> list[int]:
        """Ids of one of the n best segmentations, from those of the best and the segments that differ."""
        segs = SEGMENT.findall(b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "surrogatepass"))
        new, out, at = dict(changes), [], 0
        for k, seg in enumerate(segs):
            a, size = at, len(seg.encode("utf-8", "surrogatepass"))
            while size:
                size -= len(self.out[ids[at]])
                at += 1
            out += new.get(k, ids[a:at])
        return out


class Decoder:
    """Bytes of pieces in one array, so that many ids are turned to text by a few array operations."""

    def __init__(self, out: list[bytes]):
        self.size = np.fromiter(map(len, out), np.int64, len(out))
        self.first = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(out), np.uint8)

    def texts(self, ids: pa.ListArray) -> pa.StringArray:
        """The text of each list of ids, without the space put in front; a null list gives null, bytes that aren't UTF-8 raise."""
        flat, n = ids.flatten().to_numpy().astype(np.int64), np.array([x or 0 for x in ids.value_lengths().to_pylist()], np.int64)
        size = self.size[flat]
        ends = np.cumsum(size)
        raw = self.raw[np.repeat(self.first[flat] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.append(0, ends)[np.cumsum(np.append(0, n))]
        keep = np.ones(len(raw), bool)
        keep[cut[:-1][np.diff(cut) > 0]] = False
        offsets = cut - np.cumsum(np.append(0, np.diff(cut) > 0))
        got = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[keep].tobytes()))
        got.validate(full=True)
        return pa.compute.if_else(ids.is_null(), None, got).cast(pa.string())


_encoders: dict[str, Encoder] = {}


def decode(df: DataFrame, path: str = MODEL) -> DataFrame:
    """All columns of df and decoded: the text that the column ids stands for (null where ids is)."""
    vocabulary = df.sparkSession.sparkContext.broadcast(Decoder(outputs(*load(path))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([*b.columns, vocabulary.value.texts(b.column("ids"))], names=[*b.schema.names, "decoded"])

    return df.mapInArrow(rows, StructType([*df.schema.fields, StructField("decoded", StringType())]))


def _changes(found: list[list[list[tuple[int, list[int]]]]]) -> pa.ListArray:
    """An Arrow list per text of a list per segmentation of (segment, ids)."""
    lists = [e for f in found for e in f]
    pairs = [p for e in lists for p in e]

    def ends(of: list) -> pa.Array:
        return pa.array(np.cumsum([0, *map(len, of)]).astype(np.int32))

    ids = pa.ListArray.from_arrays(ends([i for _, i in pairs]), pa.array([x for _, i in pairs for x in i], pa.int32()))
    each = pa.StructArray.from_arrays([pa.array([k for k, _ in pairs], pa.int32()), ids], ["segment", "ids"])
    return pa.ListArray.from_arrays(ends(found), pa.ListArray.from_arrays(ends(lists), each))


def encode(docs: DataFrame, n: int = N_BEST, path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids, n_best_scores (best first), n_best_changes (per segmentation: changed segments with their ids), round_trip (the Decoder that decode() uses gives the text back, in the same worker)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.get(path)
        if enc is None:
            enc = _encoders[path] = Encoder(*vocabulary.value)
        back = Decoder(enc.out)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                texts = b.column("text").to_pylist()
                ids, sizes, scores, changes = enc.encode_all(texts, n)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, sizes)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        pa.array(sizes),
                        lists,
                        pa.array(scores, pa.list_(pa.float64())),
                        _changes(changes),
                        pa.compute.equal(back.texts(lists), pa.compute.fill_null(b.column("text"), "")),
                    ],
                    names=["doc_id", "n_pieces", "ids", "n_best_scores", "n_best_changes", "round_trip"],
                )

    schema = "doc_id long, n_pieces long, ids array<int>, n_best_scores array<double>, n_best_changes array<array<struct<segment: int, ids: array<int>>>>, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)
