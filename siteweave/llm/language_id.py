"""Language ID with language-bitmask n-gram filters.

Every learned language is one bit. A bit-sliced Bloom filter is an array of slots of bitmasks (as many 64-bit words as the languages
need); an n-gram's HASHES slots, ANDed, give at once all languages that (may) contain it. A text's n-grams are looked up, the bits are counted per
language, the counts are corrected by each slice's false-positive rate, and the language of the largest corrected count wins.

N-grams are 3 and 4 bytes of the lower-cased UTF-8 text, with everything but letters turned into spaces, at most one in a row. Their
counts per language cover all training documents (packed per task, summed by Spark). A language contains an n-gram if that is at least LEAST_SHARE of the
n-grams of the language, which holds for all n-grams of a small language and bounds their number in a large one, and unless it is there SHARE times
rarer (relative to the language's size) than in the language where it is most common: such n-grams come from quotations and names.
The filter has FILL slots for each n-gram counted in, up to MOST_WORDS words in all; beyond, it gets fuller, which the correction allows for.

Training: documents with text and non-null lang whose crc32(doc_id as text) modulo 5 is not 0. Defined results: null text, text
without a letter, or nothing learned: ``und`` with score 0; a text whose n-grams are all unknown: the first learned language, score
0; ties: the alphabetically first; a null doc_id is not learned from and counts as not held out; repeated rows give repeated results. Long texts are
worked through in pieces cut at spaces (a word of more than a piece is cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.bytehash import U, mix
from siteweave.llm.common import durable

HASHES, FILL, LEAST_WORDS, MOST_WORDS = 2, 16, 1 << 16, 1 << 22
LEAST_SHARE, SHARE = 2e-6, 0.3
#: Bytes of a piece, and n-grams that a task holds per language before they are added up.
_PIECE_BYTES, _HELD = 1 << 20, 8


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


_ASCII = bytes(c if 97 <= c <= 122 else 32 for c in range(256))
_NOT_LETTERS = str.maketrans({c: " " for c in range(128) if not chr(c).isalpha()})


def _fold(text: str | None) -> bytes:
    """Lower case, ASCII other than letters as spaces; other characters are kept if they are letters."""
    if not text:
        return b""
    low = text.lower().translate(_NOT_LETTERS) if not text.isascii() else None
    if low is None:
        return text.encode().lower().translate(_ASCII)
    odd = {ord(c): " " for c in set(low) if not c.isalpha() and c != " "}
    return (low.translate(odd) if odd else low).encode("utf-8", "surrogatepass")


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Pieces of texts, about _PIECE_BYTES together, with the texts' numbers. A space between two pieces counts for both."""
    owners, run, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t) or not at:
            end = len(t)
            if end - at > _PIECE_BYTES:
                end = t.rfind(b" ", at + 1, at + _PIECE_BYTES)
                end = at + _PIECE_BYTES if end < 0 else end
            if run and size + end - at > _PIECE_BYTES:
                yield np.array(owners), run
                owners, run, size = [], [], 0
            owners.append(i)
            run.append(t[at:end])
            size += end - at
            at = max(end, 1)
    if run:
        yield np.array(owners), run


def grams(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of texts as 32-bit codes (3 bytes below 2**24, 4 bytes above), and the text of each."""
    raw = np.frombuffer(b"".join([b" " + t + b" " for t in run]), np.uint8)
    owner = np.repeat(np.arange(len(run)), [len(t) + 2 for t in run])
    space = raw == 32
    keep = ~(space & np.append(False, space[:-1] & (owner[1:] == owner[:-1])))  # one space in a row
    b, owner = raw[keep].astype(np.uint32), owner[keep]
    three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    inside = (owner[2:] == owner[:-2]) & (b[1:-1] != 32)
    four = three[:-1] << 8 | b[3:]
    longer = inside[:-1] & (owner[3:] == owner[:-3]) & (b[2:-1] != 32)
    return np.concatenate([three[inside], four[longer]]), np.concatenate([owner[:-2][inside], owner[:-3][longer]])


def _slots(codes: np.ndarray, slots: int) -> list[np.ndarray]:
    h = mix(codes.astype(U) + U(0x1000003D))
    return [((h >> U(32 * k)) & U(slots - 1)).astype(np.int64) for k in range(HASHES)]


class Filter:
    """languages, the masks (word, slot), and each slice's false-positive rate (its share of set bits to the power of HASHES)."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        self.false = np.array([np.count_nonzero(self.masks[k >> 6] >> U(k & 63) & U(1)) / masks.shape[1] for k in range(len(languages))]) ** HASHES

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of n-grams of each folded text, and how many of them each language contains, corrected for false positives (language, text)."""
        total, found = np.zeros(len(texts)), np.zeros((len(self.languages), len(texts)))
        for owners, run in _pieces(texts):
            codes, part = grams(run)
            owner = owners[part]
            total += np.bincount(owner, minlength=len(texts))
            slots = _slots(codes, self.masks.shape[1])
            for word, masks in enumerate(self.masks):
                hit = masks[slots[0]]
                for more in slots[1:]:
                    hit &= masks[more]
                for k in range(64 * word, min(64 * word + 64, len(self.languages))):
                    found[k] += np.bincount(owner, weights=(hit >> U(k & 63) & U(1)).astype(np.float64), minlength=len(texts))
        false = self.false[:, None]
        return total, np.maximum(0.0, (found - total * false) / (1 - false + 1e-12))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        total, found = self.counts([_fold(t) for t in texts])
        share = found / np.maximum(total, 1)
        out: list[tuple[str, float]] = []
        for i, text in enumerate(texts):
            if text is None or not any(map(str.isalpha, text)) or not self.languages:
                out.append(("und", 0.0))
                continue
            order = np.argsort(-share[:, i], kind="stable")
            best, next_ = share[order[0], i], share[order[1], i] if len(order) > 1 else 0.0
            out.append((self.languages[order[0]], min(1.0, float(best / (best + next_) if best > 0 else 0.0))))
        return out


def learn(docs: DataFrame) -> Filter:
    """The filter of all training documents of docs(doc_id, text, lang). The languages, and a filter of MOST_WORDS words at most, come to the driver."""
    rows = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    languages = [r[0] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return Filter([], np.zeros((0, LEAST_WORDS), U))
    number = {x: k for k, x in enumerate(languages)}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes, inv = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(inv, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)

        for b in batches:
            for lang, own in b.groupby("lang"):
                for _, run in _pieces([_fold(t) for t in own["text"]]):
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(grams(run)[0], return_counts=True))
                    if len(parts) > _HELD:
                        held[lang] = [merged(parts)]
        for lang, parts in held.items():
            codes, n = merged(parts)
            for lo in range(0, len(codes), 200_000):
                yield pd.DataFrame({"code": codes[lo : lo + 200_000].astype(np.int64), "k": number[lang], "n": n[lo : lo + 200_000]})

    by = durable(rows.mapInPandas(counted, "code long, k int, n long").groupBy("code", "k").agg(F.sum("n").alias("n")))
    sizes = {r["k"]: r["n"] for r in by.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    size = F.get(F.from_json(F.lit(str([sizes.get(k, 1) for k in range(len(languages))])), "array<double>"), F.col("k"))
    each = by.withColumn("share", F.col("n") / size).groupBy("code").agg(F.max("share").alias("top"), F.collect_list(F.struct("k", "share")).alias("own"))
    kept = F.filter("own", lambda x: (x["share"] >= LEAST_SHARE) & (x["share"] >= SHARE * F.col("top")))
    entries = durable(each.select("code", F.explode(kept).alias("x")).select("code", "x.k"))
    words = -(-len(languages) // 64)
    n = entries.select("code").distinct().count()
    slots = min(max(LEAST_WORDS, 1 << (FILL * n).bit_length()), 1 << (MOST_WORDS // words).bit_length() - 1)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = b["k"].to_numpy()
            for s in _slots(b["code"].to_numpy(), slots):
                yield pd.DataFrame({"word": k >> 6, "slot": s, "mask": np.left_shift(U(1), (k & 63).astype(U)).view(np.int64)})

    bits = entries.mapInPandas(spread, "word int, slot long, mask long").groupBy("word", "slot").agg(F.expr("bit_or(mask)").alias("mask")).toPandas()
    masks = np.zeros((words, slots), U)
    masks[bits["word"].to_numpy(np.int64), bits["slot"].to_numpy(np.int64)] = bits["mask"].to_numpy(np.int64).view(U)
    return Filter(languages, masks)


def identify(docs: DataFrame, model: Filter | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the winner's corrected count among the two best)."""
    known = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = known.value.predict(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInPandas(rows, "doc_id long, held_out boolean, lang_pred string, score double")
