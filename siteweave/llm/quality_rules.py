"""Quality rules: counting rules over a whole text, then a linear-chain CRF over its lines.

The CRF has two states, content and boilerplate. Viterbi decoding labels the lines of a text that have a word; a
text is kept if at least KEEP_SHARE of its words are in content lines and the counting rules don't fail it.

Lines are labelled for training as follows. A line is common if it occurs in at least COMMON_SHARE of all documents (and COMMON_LEAST of them) next to
as many different lines, before and after it; copies of whole documents don't make a line common. Common lines are boilerplate. Other lines of
documents of quality 1 are content. Of those of quality 0, lines that a line rule marks (symbols, shouting, odd words, repeats) are
boilerplate and the rest is unknown, or all boilerplate if no line is marked. The CRF's start, transition and emission weights maximise the
likelihood of the known labels, the unknown ones summed out (difference of two forward-backward passes). Without usable labels PRIOR holds.

Plan: line hashes are counted over all documents with partial aggregation; those of common lines, at most 1 / COMMON_SHARE times the mean
number of lines, are broadcast. At most TRAIN_ROWS documents (of the smallest xxhash64 of doc_id) give their line features to the driver. One pass over
the documents with Arrow batches decides; no text is shuffled.

Defined results: null text counts as empty; an empty text has no words, so the base rules fail it; repeated rows give
repeated results; null doc_id is passed through; columns other than doc_id and text are ignored (kept by ``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 2000
KEEP_SHARE = 0.25
#: A common line has so many different neighbours, as a share of the documents and at least.
COMMON_SHARE, COMMON_LEAST = 0.0025, 20
#: Chains are cut into pieces of so many lines for training.
PIECE = 100
#: Rows of a batch that are worked through at a time.
ROWS = 500
WINDOW = 8
SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
#: Upper ends of the buckets of each line feature; each feature has one bucket more than ends.
ENDS = {
    "words": (2, 5, 10, 20),
    "symbols": (0.001, 0.02, 0.05, 0.1),
    "upper": (0.05, 0.2, 0.5),
    "digits": (0.001, 0.1, 0.3),
    "shouts": (0.001, 0.02, 0.06),
    "word_length": (2.5, 7, 10),
    "repeated": (0.5,),
    "stop": (0.5,),
    "common": (0.5,),
}
_STARTS = np.cumsum([0] + [len(e) + 1 for e in ENDS.values()]).tolist()
N_FEATURES = _STARTS[-1] + 1  # and a bias
#: Weights (boilerplate minus content) of symbol-heavy and shouting lines before any training.
PRIOR = ("symbols", "shouts")
#: Features whose buckets from this one on mark a line of a bad document, or up to this one if negative.
MARKS = {"symbols": 2, "shouts": 2, "upper": 3, "digits": 3, "repeated": 1, "word_length": -1}
#: Seed of the line hashes, which Spark's xxhash64 has, too.
_HASH_SEED = 42


def count_text(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words)


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words that lie in an n-word window found at least twice."""
    if len(words) <= n:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = h[: len(h) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    order = np.sort(key)
    if not (order[1:] == order[:-1]).any():
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    step = 1
    while step < n:  # exact: pairs of ranks of half the length, ranked again
        add = min(step, n - step)
        pair = rank[: len(rank) - add] * (int(rank.max()) + 1) + rank[add:]
        rank = np.unique(pair, return_inverse=True)[1].ravel()
        step += add
    again = np.bincount(rank)[rank] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + n, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def line_hash(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line, _HASH_SEED)


def line_features(text: str | None, common: frozenset[int] = frozenset()) -> tuple[list[list[int]], list[int]]:
    """Feature indexes and word counts of the lines that have a word."""
    feats, sizes, seen = [], [], set()
    ends = list(ENDS.values())
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = len(line.split())
        if not words:
            continue
        solid = line.translate(None, SPACE)
        n = len(solid)
        letters = n - len(solid.translate(None, _LOWER))
        upper = n - len(solid.translate(None, _UPPER))
        values = (
            words,
            (n - len(solid.translate(None, SYMBOLS))) / n,
            upper / max(1, upper + letters),
            (n - len(solid.translate(None, _DIGIT))) / n,
            solid.count(b"!") / n,
            n / words,
            float(line in seen),
            float(solid[-1:] in b".!?:;\""),
            float(bool(common) and line_hash(line) in common),
        )
        seen.add(line)
        own = [N_FEATURES - 1]
        for start, e, v in zip(_STARTS, ends, values, strict=False):
            k = 0
            for end in e:
                if v < end:
                    break
                k += 1
            own.append(start + k)
        feats.append(own)
        sizes.append(words)
    return feats, sizes


def line_labels(feats: np.ndarray, quality: int) -> np.ndarray:
    """1 boilerplate, 0 content, -1 unknown, for the lines (rows of feature indexes) of a labelled document."""
    names, at = list(ENDS), feats[:, 1:] - np.array(_STARTS[:-1])
    is_common = at[:, names.index("common")] > 0
    if quality:
        return is_common.astype(int)
    marked = np.zeros(len(feats), bool)
    for name, k in MARKS.items():
        column = at[:, names.index(name)]
        marked |= column >= k if k > 0 else column <= -k - 1
    return np.where(is_common | marked, 1, -1 if marked.any() else 1)


Chain = tuple[np.ndarray, np.ndarray]


class Crf:
    """Two-state chain. theta holds emission (boilerplate over content, by feature), then the scores of a start in boilerplate and of switches to and from it."""

    def __init__(self, theta: np.ndarray):
        self.theta = np.asarray(theta, float)
        self.emission = self.theta[:N_FEATURES].tolist()
        self.start, self.to_boiler, self.to_content = self.theta[N_FEATURES:].tolist()

    @classmethod
    def prior(cls) -> Crf:
        w = [0.0] * (N_FEATURES + 3)
        for name in PRIOR:
            i = list(ENDS).index(name)
            for k in range(len(ENDS[name])):
                w[_STARTS[i] + k + 1] = 1.0 + k
        w[_STARTS[list(ENDS).index("common")] + 1] = 2.0
        w[N_FEATURES - 1], w[N_FEATURES + 1], w[N_FEATURES + 2] = -1.5, -0.5, -0.5
        return cls(np.array(w))

    @staticmethod
    def packed(chains: list[Chain]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature indexes (chain, line, feature), labels padded with -2, and weights of the chains."""
        longest = max(len(y) for _, y in chains)
        feats = np.zeros((len(chains), longest, chains[0][0].shape[1]), np.int64)
        labels = np.full((len(chains), longest), -2)
        for c, (f, y) in enumerate(chains):
            feats[c, : len(y)], labels[c, : len(y)] = f, y
        return feats, labels, 1 / np.sqrt((labels > -2).sum(1))

    def slope(self, feats: np.ndarray, labels: np.ndarray, weight: np.ndarray, decay: float = 1e-3) -> tuple[float, np.ndarray]:
        """Penalised weighted log-likelihood of the known labels, and its gradient."""
        real = labels > -2
        emit = np.where(real, np.take(self.theta[:N_FEATURES], feats).sum(2), 0.0)
        value, grad = -0.5 * decay * float(self.theta @ self.theta), -decay * self.theta
        for sign, known in ((1.0, True), (-1.0, False)):
            score = np.stack([np.zeros_like(emit), emit], 2)
            if known:
                score[labels == 1, 0] = score[labels == 0, 1] = -np.inf
            total, boiler, switches = self._passes(score, real)
            value += sign * float(weight @ total)
            p = sign * weight[:, None] * np.where(real, boiler, 0.0)
            grad[:N_FEATURES] += np.bincount(feats.ravel(), weights=np.repeat(p.ravel(), feats.shape[2]), minlength=N_FEATURES)
            grad[N_FEATURES] += p[:, 0].sum()
            grad[N_FEATURES + 1 :] += sign * (weight @ switches)
        return value, grad

    def _passes(self, score: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of chains: log of the sum over all paths, P(boilerplate) by line, and expected switches to and from boilerplate."""
        n, longest, _ = score.shape
        ahead, behind = np.empty((longest, n, 2)), np.zeros((longest, n, 2))
        ahead[0] = score[:, 0] + [0.0, self.start]
        for t in range(1, longest):
            c, b = ahead[t - 1].T
            step = np.stack([np.logaddexp(c, b + self.to_content), np.logaddexp(b, c + self.to_boiler)], 1) + score[:, t]
            ahead[t] = np.where(real[:, t, None], step, ahead[t - 1])
        for t in range(longest - 2, -1, -1):
            c, b = (behind[t + 1] + score[:, t + 1]).T
            step = np.stack([np.logaddexp(c, b + self.to_boiler), np.logaddexp(b, c + self.to_content)], 1)
            behind[t] = np.where(real[:, t + 1, None], step, 0.0)
        total = np.logaddexp(*ahead[-1].T)
        boiler = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total).T
        after = behind[1:] + score.transpose(1, 0, 2)[1:]
        there, back = (np.exp(ahead[:-1, :, i] + after[:, :, 1 - i] + move - total) for i, move in ((0, self.to_boiler), (1, self.to_content)))
        follows = real[:, 1:].T
        return total, boiler, np.stack([(there * follows).sum(0), (back * follows).sum(0)], 1)

    def fit(self, chains: list[Chain], rounds: int = 120, rate: float = 0.3) -> Crf:
        """Gradient ascent with a step per weight (sums of squared slopes)."""
        pieces = [(f[a : a + PIECE], y[a : a + PIECE]) for f, y in chains for a in range(0, len(y), PIECE)]
        if not pieces:
            return self
        data, crf = self.packed(pieces), self
        squares = np.full(len(self.theta), 1e-6)
        for _ in range(rounds):
            _, grad = crf.slope(*data)
            squares += grad**2
            crf = Crf(crf.theta + rate * grad / np.sqrt(squares))
        return crf

    def viterbi(self, feats: list[list[int]]) -> list[bool]:
        """True for each line decoded as content; ties prefer content."""
        w, to_boiler, to_content = self.emission, self.to_boiler, self.to_content
        content, boiler, back = 0.0, self.start, []
        for t, own in enumerate(feats):
            e = sum(w[f] for f in own)
            if t:
                from_c, from_b = content >= boiler + to_content, content + to_boiler > boiler
                back.append((from_c, from_b))
                content, boiler = max(content, boiler + to_content), max(boiler, content + to_boiler) + e
            else:
                boiler += e
        state, out = content >= boiler, []
        for t in range(len(feats) - 1, -1, -1):
            out.append(state)
            if t:
                from_c, from_b = back[t - 1]
                state = from_c if state else from_b
        return out[::-1]


def common_lines(docs: DataFrame, share: float = COMMON_SHARE, least: int = COMMON_LEAST) -> frozenset[int]:
    """Hashes of the common lines of all documents; at most 1 / share times the mean number of lines come to the driver."""
    lines = F.split("text", "\n", -1)
    n = docs.filter("text is not null").count()
    most = max(least, share * n)
    placed = docs.filter("text is not null").select(F.transform(lines, lambda x: F.xxhash64(x)).alias("h"))
    often = placed.select(F.explode(F.array_distinct("h")).alias("line")).groupBy("line").count().filter(F.col("count") >= most).select("line")
    at = placed.select("h", F.posexplode("h").alias("i", "line")).join(F.broadcast(often), "line")
    sides = at.select("line", F.explode(F.array(*(F.struct(F.lit(d > 0).alias("after"), F.coalesce(F.get("h", F.col("i") + d), F.lit(0)).alias("other")) for d in (-1, 1)))).alias("s"))
    found = sides.select("line", "s.after", "s.other").distinct().groupBy("line").agg(F.count_if("after").alias("after"), F.count_if(~F.col("after")).alias("before")).filter((F.col("after") >= most) & (F.col("before") >= most))
    return frozenset(r[0] & 0xFFFFFFFFFFFFFFFF for r in found.select("line").collect())


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Crf, frozenset[int]]:
    """A CRF from at most ``rows`` labelled documents, and the common lines of all documents."""
    common = common_lines(docs)
    shared = docs.sparkSession.sparkContext.broadcast(common)
    chosen = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            feats = [line_features(t, shared.value)[0] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "n": [len(f) for f in feats], "feats": [np.array(f, np.uint8).tobytes() for f in feats]})

    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    data = own.mapInPandas(features, "doc_id long, quality int, n int, feats binary").filter("n > 0").dropDuplicates(["doc_id"]).collect()
    chains = []
    for r in sorted(data, key=lambda r: r["doc_id"]):
        f = np.frombuffer(r["feats"], np.uint8).reshape(r["n"], -1).astype(np.int64)
        chains.append((f, line_labels(f, r["quality"])))
    return Crf.prior().fit(chains), common


def judge(docs: DataFrame, labels: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (whole.iloc[lo : lo + ROWS] for whole in batches for lo in range(0, len(whole), ROWS)):
            yield pd.DataFrame([(i, *verdict(t, *model.value, keep_share)) for i, t in zip(b["doc_id"], b["text"], strict=True)], columns=COLUMNS).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(rows, SCHEMA)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def verdict(text: str | None, crf: Crf, common: frozenset[int], keep_share: float) -> tuple:
    n, chars, symbols, dup, repeat = count_text(text)
    failed = n < 20 or 100 * repeat > 30 * n
    feats, sizes = line_features(text, common)
    share = sum(s for s, good in zip(sizes, crf.viterbi(feats), strict=True) if good) / n if n else 0.0
    return n, chars, symbols, dup, repeat, failed, not failed and share >= keep_share, share


def keep_good(docs: DataFrame, labels: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The kept documents with all their columns."""
    model, schema = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)), docs.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            keep = [verdict(t, *model.value, keep_share)[6] for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(rows, schema)
