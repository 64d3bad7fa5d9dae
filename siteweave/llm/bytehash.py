"""Vectorised fingerprints of words and byte windows of a batch of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
_SEED = np.random.default_rng(0x5EED)
#: A random 64-bit value for each byte, an odd base and its inverse modulo 2**64.
BYTE = _SEED.integers(1, 2**63, 256, dtype=np.int64).view(U) * U(2) + U(1)
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n + n // 4, 1 << 18)
        p = np.full(size, U(base))
        p[0] = 1
        have = _powers[base] = np.cumprod(p, dtype=U)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def pieces(texts: Iterable[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 bytes) of runs of texts of about ``most`` bytes; a longer text stands alone."""
    run, size, first = [], 0, 0
    for i, t in enumerate(texts):
        raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if run and size + len(raw) > most:
            yield first, run
            run, size, first = [], 0, i
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run


def word_hashes(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lowered) of a run, and where each text's words begin, with the end."""
    raw = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
    solid = ~IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    n = len(raw)
    total = np.zeros(n + 1, U)
    np.cumsum(BYTE[LOWERED[raw]] * powers(BASE, n), out=total[1:])
    h = mix((total[ends] - total[starts]) * powers(INVERSE, n)[starts])
    text_starts = np.cumsum([0] + [len(r) + 1 for r in run])
    return h, np.searchsorted(starts, text_starts)


def shingle_sets(run: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; a text of fewer words has its whole sequence as one."""
    h, at = word_hashes(run)
    n = len(h)
    joint = np.zeros(max(0, n - words + 1), U)
    for k in range(words):
        joint = joint * U(0x9E3779B97F4A7C15) + h[k : k + len(joint)]
    joint = mix(joint)
    out = []
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if z - a >= words:
            out.append(np.unique(joint[a : z - words + 1]))
        elif z > a:
            whole = np.array([z - a], U)
            for x in h[a:z]:
                whole = whole * U(0xA24BAED4963EE407) + x
            out.append(mix(whole))
        else:
            out.append(np.empty(0, U))
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the graph with edges a-b: every node that is not the least of its component, and that least."""
    if not len(a):
        return a[:0], b[:0]
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        differ = ru != rv
        if not differ.any():
            break
        u, v, ru, rv = u[differ], v[differ], ru[differ], rv[differ]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while not np.array_equal(up := root[root], root):
            root = up
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]
