"""Toxicity by weak supervision.

1. Voters: lexicon and pattern functions that vote toxic (1), clean (-1) or abstain (0) on a whole text. One lexicon is mined: words and
   word beginnings that are much more common in toxic than in clean training labels of the sample below. The training labels themselves are one
   more voter of the label model (``given``), of accuracy TRUST, which abstains where there is none.
2. Label model: a generative model of the votes given a hidden class, fitted by EM on the counts of all vote patterns of the
   training documents (each document counts). Voters that turn out no more accurate than the class balance are switched off, and correlations of
   voters within a class, estimated from a fit, lower the weight of correlated voters in the next. The share of toxic labels among the
   training labels starts the class balance.
3. Classifier: logistic regression on the label model's posteriors, and nothing else, of at most TRAIN_ROWS
   documents in three strata (toxic, clean, unlabelled), weighted back to their sizes; features are the text's votes and counts of up to
   VOCABULARY words and word beginnings that the posterior singles out. A shift of the intercept puts the training labels' best F1 cut at
   the threshold.

Training rows are those whose crc32(doc_id as text) modulo 4 is not 2; labels, lang, source and doc_id are never inputs of a score.
Broadcast and collected: vote pattern counts (at most 3 ** voters, in practice hundreds), TRAIN_ROWS rows, the model.

Plan: one pass gathers the sample, one counts patterns, one scores, each a batch of texts at a time; no document text is shuffled, only the
(doc_id, votes) rows that meet their labels.

Defined results: null or empty text has no votes but the clean ones and gets that score; without any training row the classifier is the
sum of the votes; repeated rows give repeated results; null doc_id is never trained on. Long texts are worked through in pieces cut at
ASCII punctuation or spaces (a word of more than a piece is cut).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.bytehash import BASE, BYTE, INVERSE, U, mix, powers

TRAIN_ROWS, VOCABULARY, THRESHOLD = 8000, 3000, 0.3
#: Accuracy of the given labels; those of all other voters are estimated.
TRUST = 0.999
#: Rounds of estimating correlations and fitting again.
ROUNDS = 4
#: Mined lexicon: at least so many toxic documents with the code, and so many times as common there as in clean ones.
MINED_LEAST, MINED_RATIO, MINED = 6, 12.0, 1000
#: Lengths in bytes of word beginnings, and the counts at which a code makes a further feature.
BEGINNINGS, LEVELS = (4, 5, 6, 7), (1, 2, 4)
#: Lexicons of the voters (fixed values), as whole words or phrases of lower-cased text.
LEXICONS: dict[str, str] = {
    "intellect": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile cretin dimwit dunce halfwit brainless airhead blockhead nitwit dullard simpleton",
    "worth": "worthless pathetic loser losers useless nobody failure reject deadbeat waste-of-space good-for-nothing miserable",
    "disgust": "disgusting scum trash garbage filth filthy vermin vile repulsive revolting gross nasty rotten sleazy slimy",
    "ridicule": "clown clowns joke laughable ridiculous buffoon fool fools foolish freak freaks weirdo creep creepy crybaby",
    "malice": "hate hateful despise loathe evil liar liars cheater coward cowards traitor snake rat pig pigs swine",
    "profanity": "damn damned hell crap crappy bastard bastards bitch bitches ass asshole shit shitty bullshit fuck fucking fucked dick prick",
    "threats": "kill-yourself shut-up drop-dead go-die get-lost die-already beat-you hurt-you destroy-you hunt-you-down hope-you-die burn-in-hell",
    "european": "dummkopf idioten arschloch trottel abschaum schwachkopf imbécile crétin connard salaud ordure merde imbécil estúpido idiota basura payaso patético asqueroso mierda",
}
POSITIVE = "please thanks thank kindly welcome sincerely appreciate grateful"
#: Votes, word codes, label.
Row = tuple[list[int], np.ndarray, int | None]
LEET = str.maketrans("013457@$!|", "oieastasil")
VOTERS = (*LEXICONS, "several", "dense", "direct", "disguised", "shouted", "polite", "nothing", "mined")
_STRETCH = re.compile(r"([a-z])\1{2,}")
_ODD_WORD = re.compile(r"\b(?=\w*[013457@$!|*]\w*)[a-z013457@$!|*]{4,14}\b")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, words in enumerate(LEXICONS.values()):
        for w in words.split():
            a.add_word(w.replace("-", " "), (k, len(w)))
    for w in POSITIVE.split():
        a.add_word(w, (len(LEXICONS), len(w)))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()
_PLAIN = {w for words in LEXICONS.values() for w in words.split() if "-" not in w}


def votes(text: str | None) -> list[int]:
    """One vote per voter but the last, which needs the mined lexicon."""
    low = (text or "").lower()
    found: list[list[tuple[int, int]]] = [[] for _ in range(len(LEXICONS) + 1)]
    n = len(low)
    for end, (k, size) in _AUTOMATON.iter(low):
        a = end - size + 1
        if (a == 0 or not low[a - 1].isalnum()) and (end + 1 == n or not low[end + 1].isalnum()):
            found[k].append((a, end + 1))
    bad = [x for f in found[:-1] for x in f]
    out = [int(bool(f)) for f in found[:-1]]
    kinds = sum(out)
    words = low.count(" ") + low.count("\n") + 1
    disguised = _disguised(low)
    out += [
        int(len(bad) >= 2 and kinds >= 2),
        1 if bad and len(bad) * 100 >= words else -1 if len(bad) * 1000 < words else 0,
        int(any(re.search(r"\b(?:you|your|you're|u|ur)\b", low[max(0, a - 25) : z + 25]) is not None for a, z in bad)),
        int(disguised),
        int(any((text or "")[a:z].isupper() for a, z in bad)) if len(low) == len(text or "") else 0,
        -1 if found[-1] and not bad else 0,
        -1 if not bad and not disguised else 0,
    ]
    return out


def _disguised(low: str) -> bool:
    """A lexicon word written with look-alike characters, stars or stretched letters."""
    if not any(c in low for c in "013457@$!|*"):
        return bool(_stretched(low))
    for w in _ODD_WORD.findall(low):
        plain = w.translate(LEET).rstrip("il")
        if plain in _PLAIN or w.translate(LEET) in _PLAIN:
            return True
        if "*" in w and any(len(w) == len(x) and all(c in ("*", y) for c, y in zip(w, x, strict=True)) for x in _PLAIN) and w.count("*") <= len(w) // 2:
            return True
    return bool(_stretched(low))


def _stretched(low: str) -> bool:
    raw = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8)
    same = raw[1:] == raw[:-1]
    if not (same[1:] & same[:-1]).any():
        return False
    return any(_STRETCH.sub(r"\1", w) in _PLAIN for m in _STRETCH.finditer(low) for w in re.findall(r"\w+", low[max(0, m.start() - 20) : m.end() + 20]))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _c in range(128):
    if not chr(_c).isalnum():
        _FOLD[_c] = 32
_PIECE_BYTES = 1 << 19
_CUT = re.compile(rb"[\x00-/:-@\[-`{-\x7f]")


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Pieces of texts, about _PIECE_BYTES together, with the texts' numbers."""
    owners, run, size = [], [], 0
    for i, t in enumerate(texts):
        raw, at = (t or "").encode("utf-8", "surrogatepass"), 0
        while at < len(raw):
            m = _CUT.search(raw, at + _PIECE_BYTES, at + 2 * _PIECE_BYTES) if len(raw) - at > _PIECE_BYTES else None
            end = m.end() if m else min(len(raw), at + 2 * _PIECE_BYTES)
            owners.append(i)
            run.append(raw[at:end])
            size += end - at
            at = end
            if size >= _PIECE_BYTES:
                yield owners, run
                owners, run, size = [], [], 0
    if run:
        yield owners, run


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, code), sorted by text: distinct 32-bit codes of the words and word beginnings (ASCII lowered, cut at ASCII punctuation) of each text, once per level of their count."""
    keys, times = [np.empty(0, U)], [np.empty(0, np.int64)]
    for owners, run in _pieces(texts):
        raw = _FOLD[np.frombuffer(b" ".join(run), np.uint8)]
        solid = raw != 32
        edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        n = len(raw)
        total = np.zeros(n + 1, U)
        np.cumsum(BYTE[raw] * powers(BASE, n), out=total[1:])
        back = powers(INVERSE, n)
        begins = np.cumsum([0] + [len(r) + 1 for r in run[:-1]])
        owner = np.array(owners, U)[np.searchsorted(begins, starts, side="right") - 1] << U(32)
        parts = [owner | mix((total[ends] - total[starts]) * back[starts]) >> U(32)]
        for k in BEGINNINGS:
            longer = ends - starts > k
            a = starts[longer]
            parts.append(owner[longer] | mix((total[a + k] - total[a]) * back[a] + U(k)) >> U(32))
        own, n_times = np.unique(np.concatenate(parts), return_counts=True)
        keys.append(own)
        times.append(n_times)
    key, inv = np.unique(np.concatenate(keys), return_inverse=True)
    n_times = np.bincount(inv, weights=np.concatenate(times), minlength=len(key))
    owner, code = (key >> U(32)).astype(np.int64), key.astype(np.uint32)
    owners, codes = (np.concatenate(x) for x in zip(*((owner[n_times >= level], code[n_times >= level] + np.uint32(level)) for level in LEVELS), strict=True))
    order = np.argsort(owners, kind="stable")
    return owners[order], codes[order]


def _slices(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Batches a few rows at a time, which bounds the arrays of their codes."""
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.iloc[lo : lo + rows]


def _by_text(n: int, owner: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
    cut = np.searchsorted(owner, np.arange(n + 1))
    return [codes[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]


def _found(sorted_: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which codes are among the sorted ones, and their places there."""
    if not len(sorted_):
        return np.zeros(len(codes), bool), np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(sorted_, codes), len(sorted_) - 1)
    return sorted_[at] == codes, at


def mined_votes(n: int, owner: np.ndarray, codes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """The last voter's votes on n texts of (owner, codes): 1 for two codes of the lexicon, -1 for none, 0 for one or an empty lexicon or text."""
    hits = np.bincount(owner[_found(lexicon, codes)[0]], minlength=n)
    out = np.where(hits > 1, 1, np.where(hits == 1, 0, -1))
    return np.where(np.bincount(owner, minlength=n) > 0, out, 0) if len(lexicon) else np.zeros(n, int)


def without_rare(rows: list[Row], least: int = MINED_LEAST) -> list[Row]:
    """The rows without the codes that occur in fewer of them."""
    codes, n = np.unique(np.concatenate([np.empty(0, np.uint32), *(w for _, w, _ in rows)]), return_counts=True)
    codes = codes[n >= least]
    return [(x, w[codes[np.minimum(np.searchsorted(codes, w), len(codes) - 1)] == w] if len(codes) else w[:0], y) for x, w, y in rows]


def mine(rows: list[Row]) -> np.ndarray:
    """Sorted codes of the mined lexicon from labelled rows."""
    by = {y: [w for _, w, label in rows if label == y] for y in (0, 1)}
    if not by[1] or not by[0]:
        return np.empty(0, np.uint32)
    toxic, n = np.unique(np.concatenate(by[1]), return_counts=True)
    clean, m = np.unique(np.concatenate([*by[0], np.empty(0, np.uint32)]), return_counts=True)
    at = np.minimum(np.searchsorted(clean, toxic), max(0, len(clean) - 1))
    in_clean = np.where(clean[at] == toxic, m[at], 0) if len(clean) else np.zeros(len(toxic))
    ratio = (n / len(by[1])) / ((in_clean + 0.5) / len(by[0]))
    good = np.flatnonzero((n >= MINED_LEAST) & (ratio >= MINED_RATIO))
    return np.sort(toxic[good[np.argsort(-n[good] * np.log(ratio[good]), kind="stable")[:MINED]]])


def mined_vote(words: np.ndarray, lexicon: np.ndarray) -> int:
    return int(mined_votes(1, np.zeros(len(words), np.int64), words, lexicon)[0])


def train_row() -> Column:
    return F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


class LabelModel:
    """P(class) and P(vote | class, voter) of VOTERS and the given labels.

    accuracies: of each voter, the probability that a vote of it is right. weights switch off voters whose accuracy is not above that of a constant
    vote for the class they speak for, and discount voters that are correlated within a class.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, balance: float):
        self.patterns, self.counts = patterns, counts.astype(float)
        m = patterns.shape[1]
        self.weights = np.ones(m)
        self.balance = balance
        start = np.clip((patterns.clip(0).sum(1) - 0.5), -1, 1)
        start = np.where(start > 0, 0.95, 0.02)
        self._fit(np.where(patterns[:, -1] != 0, (patterns[:, -1] + 1) / 2, start))
        for _ in range(ROUNDS):  # a copied voter stands out only once it weighs less
            right, chance = self._accuracies()
            self.correlations = self._correlations()
            self.weights = (right > chance) / (1 + np.maximum(self.correlations - 0.1, 0).sum(1))
            self.weights[-1] = 1.0
            self._fit(self.posterior(patterns))
        self.accuracies, _ = self._accuracies()

    def _accuracies(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each voter: probability that a vote is right, and that of as many votes for its classes at random."""
        prior = np.array([1 - self.balance, self.balance])
        joint = self.table * prior[:, None, None]  # class, voter, vote
        clean, toxic = joint[:, :, 0].sum(0), joint[:, :, 2].sum(0)
        cast = np.maximum(clean + toxic, 1e-12)
        return (joint[0, :, 0] + joint[1, :, 2]) / cast, (clean * prior[0] + toxic * prior[1]) / cast

    def _fit(self, q: np.ndarray, rounds: int = 30) -> None:
        for _ in range(rounds):
            by = np.stack([1 - q, q]) * self.counts
            self.table = np.stack([[[(by[c] * (self.patterns[:, k] == v)).sum() + 0.5 for v in (-1, 0, 1)] for k in range(self.patterns.shape[1])] for c in (0, 1)])
            self.table /= self.table.sum(2, keepdims=True)
            cast = 1 - self.table[:, -1, 1].mean()
            self.table[:, -1] = [[cast * TRUST, 1 - cast, cast * (1 - TRUST)], [cast * (1 - TRUST), 1 - cast, cast * TRUST]]
            self.balance = float(np.clip(0.5 * self.balance + 0.5 * by[1].sum() / max(by.sum(), 1e-9), 1e-3, 0.5))
            q = self.posterior(self.patterns)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        at = patterns + 1
        k = np.arange(patterns.shape[1])
        z = (np.log(self.table[1, k, at] / self.table[0, k, at]) * self.weights).sum(1) + np.log(self.balance / (1 - self.balance))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _correlations(self) -> np.ndarray:
        q = self.posterior(self.patterns)
        out = np.zeros((self.patterns.shape[1],) * 2)
        for w in (q * self.counts, (1 - q) * self.counts):
            mean = (self.patterns * w[:, None]).sum(0) / max(w.sum(), 1e-9)
            d = self.patterns - mean
            cov = (d * w[:, None]).T @ d / max(w.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            out = np.maximum(out, np.abs(cov / sd[:, None] / sd[None, :]))
        np.fill_diagonal(out, 0)
        return out


class Classifier:
    def __init__(self, vote_weights: np.ndarray, codes: np.ndarray, word_weights: np.ndarray, intercept: float, lexicon: np.ndarray):
        order = np.argsort(codes)
        self.lexicon = lexicon
        self.vote_weights, self.codes, self.word_weights, self.intercept = vote_weights, codes[order], word_weights[order], intercept

    def margin(self, vote: list[int], words: np.ndarray) -> float:
        return float(self.margins(np.array([vote]), np.zeros(len(words), np.int64), words)[0])

    def margins(self, vote: np.ndarray, owner: np.ndarray, codes: np.ndarray) -> np.ndarray:
        hit, at = _found(self.codes, codes)
        return self.intercept + vote @ self.vote_weights + np.bincount(owner[hit], weights=self.word_weights[at[hit]], minlength=len(vote))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        owner, codes = coded(texts)
        vote = np.array([votes(t) for t in texts], float).reshape(len(texts), len(VOTERS) - 1)
        vote = np.concatenate([vote, mined_votes(len(texts), owner, codes, self.lexicon)[:, None]], 1)
        return 1 / (1 + np.exp(-np.clip(self.margins(vote, owner, codes), -30, 30)))


def fit_classifier(rows: list[Row], posterior: np.ndarray, weight: np.ndarray, lexicon: np.ndarray, folds: int = 3) -> Classifier:
    """Classifier of all rows (votes, word codes, label or None), whose threshold is the cut of best F1 among margins of rows left out of the fit."""
    model = _descend(rows, posterior, weight, lexicon)
    labelled: list[tuple[float, int, float]] = []
    part = np.arange(len(rows)) % folds
    for f in range(folds if len(rows) >= 10 * folds else 0):
        own = mine([r for r, k in zip(rows, part, strict=True) if k != f])
        again = [([*x[:-1], mined_vote(w, own)], w, y) for x, w, y in rows]
        part_model = _descend([r for r, k in zip(again, part, strict=True) if k != f], posterior[part != f], weight[part != f], own)
        labelled += [(part_model.margin(x, w), y, u) for (x, w, y), k, u in zip(again, part, weight, strict=True) if k == f and y is not None]
    if len({y for _, y, _ in labelled}) == 2:
        z, y, u = (np.array(x) for x in zip(*sorted(labelled, key=lambda p: -p[0]), strict=True))
        f1 = 2 * np.cumsum(y * u) / (np.cumsum(u) + (y * u).sum())
        f1[:-1][z[:-1] == z[1:]] = 0  # ties can't be cut
        k = int(np.argmax(f1))
        cut = (z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1
        model.intercept += float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)
    return model


def _descend(rows: list[Row], posterior: np.ndarray, weight: np.ndarray, lexicon: np.ndarray, rounds: int = 400) -> Classifier:
    """Weighted full-batch descent with a step per weight (sums of squared slopes)."""
    target = posterior
    weight = weight / weight.sum()
    flat = np.concatenate([w for _, w, _ in rows])
    owner = np.repeat(np.arange(len(rows)), [len(w) for _, w, _ in rows])
    codes, inv = np.unique(flat, return_inverse=True)
    n = np.bincount(inv, minlength=len(codes)).astype(float)
    toxic = np.bincount(inv, weights=target[owner], minlength=len(codes))
    rate = float(target.mean())
    gain = np.abs(toxic - n * rate) / np.sqrt(n * rate * (1 - rate) + 1) * (n >= 8)
    chosen = np.sort(np.argsort(-gain, kind="stable")[: min(VOCABULARY, int((gain > 3).sum()))])
    column = np.full(len(codes), -1)
    column[chosen] = np.arange(len(chosen))
    use = column[inv] >= 0
    r, c = owner[use], column[inv[use]]
    v = np.array([x for x, _, _ in rows], float).reshape(len(rows), len(VOTERS))
    a, b, bias, step = np.zeros(len(VOTERS)), np.zeros(len(chosen)), -2.0, 0.2
    ga, gb, g0 = np.full(len(VOTERS), 1e-6), np.full(len(chosen), 1e-6), 1e-6
    for _ in range(rounds):
        z = v @ a + np.bincount(r, weights=b[c], minlength=len(rows)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        da, db, d0 = v.T @ g + 1e-4 * a, np.bincount(c, weights=g[r], minlength=len(chosen)) + 5e-4 * b, g.sum()
        ga, gb, g0 = ga + da**2, gb + db**2, g0 + d0**2
        a, b, bias = a - step * da / np.sqrt(ga), b - step * db / np.sqrt(gb), bias - step * d0 / np.sqrt(g0)
    return Classifier(a, codes[chosen], b, float(bias), lexicon)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[LabelModel, Classifier]:
    """Label model and classifier from training rows only."""
    spark = docs.sparkSession
    train = docs.filter(train_row()).select("doc_id", "text")
    given = labels.filter(train_row() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = train.select("doc_id").distinct().join(given, "doc_id", "left")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rooms = {1: TRAIN_ROWS // 4, 0: TRAIN_ROWS // 2, None: TRAIN_ROWS // 4}
    strata = [known.filter(F.col("toxic").eqNullSafe(y)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in rooms.items()]
    sample = strata[0].union(strata[1]).union(strata[2])

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            texts = b["text"].tolist()
            words = _by_text(len(texts), *coded(texts))
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"].astype("Int32"), "votes": [spell(votes(t)) for t in texts], "words": [w.tobytes() for w in words]})

    own = train.join(F.broadcast(sample), "doc_id").mapInPandas(sampled, "doc_id long, toxic int, votes string, words binary")
    got = sorted({r["doc_id"]: r for r in own.toLocalIterator()}.values(), key=lambda r: r["doc_id"])
    rows = without_rare([(read(r["votes"]), np.frombuffer(r["words"], np.uint32), r["toxic"]) for r in got])
    del got
    lexicon = mine(rows)
    rows = [([*x, mined_vote(w, lexicon)], w, y) for x, w, y in rows]
    shared = spark.sparkContext.broadcast(lexicon)

    def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            texts = b["text"].tolist()
            mined = mined_votes(len(texts), *coded(texts), shared.value).tolist()
            yield pd.DataFrame({"doc_id": b["doc_id"], "votes": [spell([*votes(t), m]) for t, m in zip(texts, mined, strict=True)]})

    voted_ = train.mapInPandas(voted, "doc_id long, votes string").join(given, "doc_id", "left")
    counts = voted_.groupBy("votes", "toxic").count().orderBy("votes", "toxic").collect()
    if not counts or not rows:
        model = LabelModel(np.zeros((1, len(VOTERS) + 1), int), np.ones(1), 0.05)
        return model, Classifier(np.ones(len(VOTERS)), np.empty(0, np.uint32), np.empty(0), -2.0, lexicon)
    labelled = sizes.get(0, 0) + sizes.get(1, 0)
    balance = sizes.get(1, 0) / labelled if labelled else 0.05
    model = LabelModel(np.array([[*read(r["votes"]), _label_vote(r["toxic"])] for r in counts]), np.array([r["count"] for r in counts]), float(np.clip(balance, 0.005, 0.5)))
    posterior = model.posterior(np.array([[*x, _label_vote(y)] for x, _, y in rows]))
    weight = np.array([max(1.0, sizes.get(y, 0) / rooms[y]) for _, _, y in rows])
    return model, fit_classifier(rows, posterior, weight, lexicon)


def _label_vote(toxic: int | None) -> int:
    return 0 if toxic is None else 1 if toxic else -1


def spell(vote: list[int]) -> str:
    return "".join("nap"[v + 1] for v in vote)


def read(spelled: str) -> list[int]:
    return ["nap".index(c) - 1 for c in spelled]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)[1])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            s = model.value.scores(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "score": s, "predicted": (s >= THRESHOLD).astype(int)})

    return docs.select("doc_id", held.alias("held_out"), "text").mapInPandas(rows, "doc_id long, held_out boolean, score double, predicted int")
