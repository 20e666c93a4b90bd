"""Language identification by error-correcting output codes over hashed character n-grams.

Each language has a codeword; each bit has a binary logistic classifier over hashed 1- to 3-grams of the
lower-cased letters (everything else is one space). Bits are fitted on a bounded sample on the driver; decoding
is loss-weighted: a bit counts as much as it was right on a held-back part of the sample, and the codeword
of the smallest weighted loss wins. A small margin to the second codeword flags the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, mix

BUCKETS = 1 << 12
UNDETERMINED = "und"
#: Texts of each language that are learned from, however many languages there are.
LEAST = 5
#: Texts are scanned in pieces of this many code points; counts add up over the whole text.
PIECE = 1 << 20
SPACE = 32


def _letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_LETTER: np.ndarray | None = None


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None without a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = _letters()
    if not text:
        return None
    total = np.zeros(BUCKETS, np.int64)
    any_letter = False
    for at in range(0, len(text), PIECE):
        part = np.frombuffer(text[at : at + PIECE + 2].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _LETTER[part]
        any_letter = any_letter or bool(letter.any())
        c = np.where(letter, part, SPACE).astype(np.uint64)
        c = np.r_[np.uint64(SPACE), c[np.r_[True, letter[1:] | letter[:-1]]], np.uint64(SPACE)]
        one, two = c * np.uint64(0x9E3779B97F4A7C15), c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        for h in (one, one[:-1] ^ two, one[:-2] ^ two[:-1] ^ (c[2:] * np.uint64(0x165667B19E3779F9))):
            total += np.bincount((mix(h) >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
    return total if any_letter else None


def features(c: np.ndarray) -> np.ndarray:
    x = np.sqrt(c.astype(np.float32))
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1: all splits up to 5 classes, beyond them the best of seeded random codes."""
    if n <= 5:
        cols = [[1 if i == 0 or (j >> (i - 1)) & 1 else -1 for i in range(n)] for j in range(2 ** max(n - 1, 0) - 1)]
        return np.array(cols, np.float32).T.reshape(n, -1)
    rng = np.random.default_rng(seed)
    best, distance = None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.float32), (n, int(np.ceil(10 * np.log2(n)))))
        m = m[:, np.abs(m.sum(axis=0)) < n]
        d = ((m.shape[1] - m @ m.T) / 2 + np.eye(n) * 1e9).min()
        if d > distance:
            best, distance = m, d
    return best


@dataclass
class Codes:
    """Languages, their codewords, the bits' classifiers and the bits' decoding weights."""

    langs: list[str]
    words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of the likelihood and the margin to the second, for each row of x."""
        if len(self.langs) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.ones(len(x))
        f = x @ self.weights + self.bias
        f = np.clip(f, -30, 30)
        # of bits +1 and of bits -1, so that memory does not grow with languages times bits
        loss = (np.log1p(np.exp(-f)) * self.trust) @ (self.words > 0).T + (np.log1p(np.exp(f)) * self.trust) @ (self.words < 0).T
        like = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        like /= like.sum(axis=1, keepdims=True)
        top = np.sort(like, axis=1)
        return like.argmax(axis=1), top[:, -1], top[:, -1] - top[:, -2]


def fit(x: np.ndarray, y: list[str], steps: int = 150, rate: float = 6.0, l2: float = 1e-5) -> Codes:
    """Codewords and bit classifiers; every fifth row only weighs the bits."""
    langs = sorted(set(y))
    words = codewords(len(langs))
    if len(langs) < 2:
        return Codes(langs, words, np.zeros((x.shape[1], 0), np.float32), np.zeros(0, np.float32), np.zeros(0, np.float32))
    cls = np.array([langs.index(v) for v in y])
    held = np.arange(len(y)) % 5 == 4
    share = np.bincount(cls[~held], minlength=len(langs)).clip(1)
    weight = (1.0 / share)[cls[~held]] / len(langs)  # languages count alike
    xt, t = x[~held], words[cls[~held]]
    w, b = np.zeros((x.shape[1], words.shape[1]), np.float32), np.zeros(words.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for i in range(steps):
        g = -t / (1 + np.exp(np.clip(t * (xt @ w + b), -30, 30))) * weight[:, None]
        vw = 0.9 * vw + xt.T @ g + l2 * w
        vb = 0.9 * vb + g.sum(axis=0)
        w -= rate * vw
        b -= rate * 0.1 * vb
    right = ((np.sign(x[held] @ w + b) == words[cls[held]]).mean(axis=0)) if held.any() else np.ones(words.shape[1])
    trust = np.clip(right - 0.5, 0.01, None)
    return Codes(langs, words, w.astype(np.float32), b.astype(np.float32), (trust / trust.mean()).astype(np.float32))


def train(spark: SparkSession, docs: DataFrame, per_language: int = 400, languages: int = 64) -> Codes:
    """Fit on at most `per_language` texts of every lang value; more than `languages` values share as many texts in all.

    docs(doc_id, text, lang) holds the learnable rows; the sample is that of the smallest hashes of doc_id, and
    of each of its texts only hashed counts reach the driver: per_language * languages * BUCKETS * 4 bytes
    at most, here 400 MB from 64 languages on and 26 MB at 4, but LEAST texts of every language. No usable row gives a model without a language.
    """
    rows = docs.filter("text is not null and lang is not null")
    per_language = min(per_language, max(LEAST, per_language * languages // max(rows.select("lang").distinct().count(), 1)))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(11))
    ranked = rows.select("doc_id", "lang", order.alias("h"), F.pmod(order, F.lit(16)).alias("salt"))
    # first within salted parts, so that no task ranks all rows of a frequent language
    for by in (("lang", "salt"), ("lang",)):
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))).filter(F.col("r") <= per_language).drop("r")
    ids = ranked.select("doc_id", "lang").distinct()
    sample = rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [counts(t) for t in b.column(2).to_pylist()]
            keep = [i for i, v in enumerate(c) if v is not None]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64())), pa.array([features(c[i]).astype(np.float16).tobytes() for i in keep], pa.binary())], ["doc_id", "lang", "x"])

    got = sorted(sample.mapInArrow(run, "doc_id long, lang string, x binary").toLocalIterator(), key=lambda r: (r.lang, r.doc_id, bytes(r.x)))
    kept: dict[str, int] = {}
    got = [r for r in got if kept.setdefault(r.lang, 0) < per_language and not kept.update({r.lang: kept[r.lang] + 1})]
    if not got:
        return Codes([], np.zeros((0, 0)), np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(0))
    return fit(np.stack([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32), [r.lang for r in got])


def identify(spark: SparkSession, docs: DataFrame, model: Codes, text: str = "text", ambiguous_below: float = 0.2) -> DataFrame:
    """All columns of docs and lang_pred, score (0 to 1), ambiguous.

    The whole text counts and nothing else. Null texts, texts without a letter and a model without a language
    give `und`, score 0, not ambiguous. Input columns named like a result are replaced. Ties go to the first
    language by name. Repeated rows get equal results; an empty table gives no rows.
    """
    bound_batches(spark)
    own = docs.drop("lang_pred", "score", "ambiguous")
    shared = spark.sparkContext.broadcast(model)  # BUCKETS * bits * 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            c = [counts(t) for t in b.column(1).to_pylist()]
            keep = [i for i, v in enumerate(c) if v is not None] if m.langs else []
            lang, score, unsure = [UNDETERMINED] * len(c), np.zeros(len(c)), np.zeros(len(c), bool)
            if keep:
                best, share, margin = m.decode(np.stack([features(c[i]) for i in keep]))
                for i, k, s, d in zip(keep, best, share, margin, strict=True):
                    lang[i], score[i], unsure[i] = m.langs[k], s, d < ambiguous_below
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], ["row", "lang_pred", "score", "ambiguous"])

    packed = own.select(F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("t"))
    schema = packed.select("row").schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return packed.mapInArrow(run, schema).select("row.*", "lang_pred", "score", "ambiguous")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
