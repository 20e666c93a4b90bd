"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the
counts of vote patterns (at most 3 ** labellers rows for each kind of label, whatever the number of documents)
estimates how accurate each labeller is in the good class and in each kind of bad text; documents with a known label
count in the classes that it allows. Two labellers look for abuse: a word list, and word beginnings that labelled
toxic documents have and others don't. The posterior of a pattern labels a bounded sample of documents, on which a
linear scorer over hashed words, those beginnings and byte frequencies is trained; its score of the whole document
alone decides.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, bound_batches, word_hashes

SLOTS = 1 << 14
#: Slots of telling word beginnings and words of abuse.
STEM_SLOTS = 1 << 12
#: Shares of a text that labellers read too.
SHARES = 9
SIZE = SLOTS + 256 + STEM_SLOTS + SHARES
#: Documents the scorer is trained on, at most; those of the smallest hashes of text.
SAMPLE = 6000
#: Labelled documents that word beginnings are learned from, at most, and beginnings kept, at most.
LABELLED = 40_000
STEMS = 600
#: Letters of a word beginning; toxic documents that must have it; share of its documents that must be toxic.
LETTERS = (4, 5, 6, 7, 8, 9)
SUPPORT, PURITY = 4, 0.98
#: Documents of the sample that must have a feature.
LEAST = 4
#: Weight of a telling beginning beside words and bytes; steps of the scorer's training and decay of its weights.
STEM = 2.0
RATE, DECAY, STEPS = 4.0, 1e-4, 500

#: Share of good documents that a labeller calls bad and of bad ones that those of their kind do, before any is seen;
#: the latter belief is worth so many documents, the former as many as there are without a label.
FALSE_ALARM, CATCH, BELIEF = 0.005, 0.6, 10
#: Labellers that react to one kind of bad text, where the estimation starts.
KINDS = (("symbols",), ("capitals", "exclamations", "repeated_lines"), ("columns", "sentences"), ("stutter",), ("abuse", "stems"))

# Words of abuse in English, German, French and Spanish.
ABUSE = (
    "clown disgusting idiot loser moron pathetic scum stupid trash worthless"
    " abschaum arschloch arschlöcher drecksau dummkopf schwachkopf trottel vollidiot vollidioten volltrottel"
    " abruti abrutie abrutis connard connards connasse crétin crétine crétins enfoiré imbécile imbéciles salaud salope"
    " cabrón escoria estúpida estúpido estúpidos gilipollas idiota idiotas imbécil pendejo"
).split()
_LETTER = r"[^\W\d_]"
_WORD = re.compile(rf"(?<!{_LETTER})(?:{'|'.join(ABUSE)})(?!{_LETTER})")
_WORDS, _ASCII_WORDS = re.compile(rf"{_LETTER}+"), re.compile("[a-z]+")
_ABUSE = frozenset(ABUSE)
LABELLERS = ("symbols", "capitals", "exclamations", "columns", "sentences", "word_length", "repeated_lines", "digits", "stutter", "abuse", "stems")
#: What is known of a document: nothing, good, or bad of some kind; toxic ones are of the last kind.
UNKNOWN, GOOD, POOR, TOXIC = range(4)


@dataclass
class Measures:
    """What labellers and scorer read of one text."""

    votes: tuple[int, ...]
    words: np.ndarray
    bytes: np.ndarray
    told: set[str]
    abuse: int
    shares: np.ndarray


def lowered(text: str | None) -> str:
    low = text or ""
    return (low if low.isascii() or unicodedata.is_normalized("NFC", low) else unicodedata.normalize("NFC", low)).lower()


def word_set(low: str) -> set[str]:
    """Words of letters of a text in lower case."""
    return set((_ASCII_WORDS if low.isascii() else _WORDS).findall(low))


def abuse_words(low: str, words: set[str]) -> list[str]:
    """Words of abuse, each time they stand there, whatever marks stand around them."""
    return [] if words.isdisjoint(_ABUSE) else _WORD.findall(low)


def beginnings(words) -> set[str]:
    return {w[:n] for n in LETTERS for w in words if len(w) >= n}


@lru_cache(8)
def _shortest(lexicon: frozenset[str]) -> frozenset[str]:
    return frozenset(x[: LETTERS[0]] for x in lexicon)


def told_by(words: set[str], lexicon: frozenset[str]) -> set[str]:
    """Beginnings in the lexicon; most words are out by their first letters."""
    first, n = _shortest(lexicon), LETTERS[0]
    return beginnings([w for w in words if w[:n] in first]) & lexicon


def measure(text: str | None, lexicon: frozenset[str] = frozenset()) -> Measures:
    """Votes (1 good, -1 bad, 0 none) and features of a whole text; null is read as empty."""
    low = lowered(text)
    words = word_set(low)
    told = told_by(words, lexicon) if lexicon else set()
    abuse = abuse_words(low, words)
    raw = (text or "").encode("utf-8", "surrogatepass")
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    w = word_hashes(text)
    n, size = max(len(w), 1), max(len(raw), 1)
    letters = int(h[65:91].sum() + h[97:123].sum() + h[128:].sum() // 2)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks = int(h[33] + h[46] + h[63])

    def vote(bad: bool, good: bool) -> int:
        return -1 if bad else 1 if good else 0

    stutter = float((w[1:] == w[:-1]).sum()) / n
    symbols = h[[35, 36, 37, 38, 42, 60, 62, 64, 94, 95, 126]].sum() / size
    capitals = h[65:91].sum() / max(letters, 1)
    votes = (
        vote(symbols > 0.05, symbols < 0.01),
        vote(capitals > 0.5 and letters > 20, capitals < 0.2),
        vote(h[33] / n > 0.3 and h[33] > 5, h[33] == 0),
        vote(h[124] / n > 0.2 and h[124] > 3, h[124] == 0),
        vote(len(w) > 60 and marks < len(w) / 60, marks >= len(w) / 40),
        vote(size / n > 14 or size / n < 3, 4.5 < size / n < 9),
        vote(len(lines) >= 4 and len(set(lines)) <= len(lines) / 2, len(lines) >= 2 and len(set(lines)) == len(lines)),
        vote(h[48:58].sum() / size > 0.15, h[48:58].sum() / size < 0.03),
        vote(stutter > 0.1 and n > 20, stutter < 0.02 and len(w) > 1),
        vote(bool(abuse), not abuse),
        vote(bool(told), not told) if lexicon else 0,
    )
    shares = (5 * symbols, capitals, h[33] / n, h[124] / n, max(0.0, 1 - 60 * marks / n) if len(w) > 60 else 0.0, abs(size / n - 7) / 7, 1 - len(set(lines)) / max(len(lines), 1), 3 * h[48:58].sum() / size, 3 * stutter)
    return Measures(votes, (w >> np.uint64(50)).astype(np.int64), h, told | {f"{x}!" for x in abuse}, len(abuse), np.clip(np.array(shares, np.float32), 0, 1))


def pattern(votes: tuple[int, ...]) -> int:
    return sum((v + 1) * 3**i for i, v in enumerate(votes))


def unpattern(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**i % 3 for i in range(len(LABELLERS))], axis=1)


@dataclass
class WeakModel:
    """Shares of the classes (good, then kinds of bad) and how each labeller votes in them."""

    share: np.ndarray  # (classes,)
    bad_vote: np.ndarray  # (classes, labellers): share of bad votes among a labeller's votes

    def classes(self, codes: np.ndarray) -> np.ndarray:
        """Posterior of every class for documents of these patterns. A missing vote says nothing."""
        v = unpattern(codes)
        like = np.log(self.share)[None, :] + (v == 0) @ np.log(self.bad_vote).T + (v == 2) @ np.log(1 - self.bad_vote).T
        like = np.exp(like - like.max(axis=1, keepdims=True))
        return like / like.sum(axis=1, keepdims=True)

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """Probability that documents of these patterns are good."""
        return self.classes(codes)[:, 0]

    def accuracies(self) -> dict[str, float]:
        """Estimated share of each labeller's votes that are right: good for the good class, bad for any other."""
        right = self.share[0] * (1 - self.bad_vote[0]) + self.share[1:] @ self.bad_vote[1:]
        return dict(zip(LABELLERS, right.round(6).tolist(), strict=True))


def estimate(codes: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, rounds: int = 80) -> WeakModel:
    """Expectation-maximisation of labeller accuracies in the good class and in each kind of bad text.

    codes, counts: documents of a pattern; known: what their label says (UNKNOWN without labels). Labellers overlap:
    several react to the same kind of bad text, so bad text has KINDS, within which votes are independent. Before any
    document is seen, labellers are believed to be conservative and those of a kind to notice it; labels and votes
    move both beliefs.
    """
    known = np.zeros(len(codes), np.int64) if known is None else known
    prior = np.full((1 + len(KINDS), len(LABELLERS)), 0.05)
    prior[0] = FALSE_ALARM
    for i, names in enumerate(KINDS, 1):
        prior[i, [LABELLERS.index(x) for x in names]] = CATCH
    allowed = np.ones((4, 1 + len(KINDS)), bool)
    allowed[GOOD, 1:] = False
    allowed[POOR, 0] = False
    allowed[TOXIC, :-1] = False
    worth = np.full((1 + len(KINDS), 1), float(BELIEF))
    worth[0] = max(BELIEF, counts[known == UNKNOWN].sum())
    model = WeakModel(np.r_[0.85, np.full(len(KINDS), 0.15 / len(KINDS))], prior)
    v = unpattern(codes)
    for _ in range(rounds):
        p = model.classes(codes) * allowed[known] + 1e-12 * allowed[known]
        p = p / p.sum(axis=1, keepdims=True) * counts[:, None]
        low, high = p.T @ (v == 0), p.T @ (v == 2)
        new = (low + worth * prior) / (low + high + worth)
        share = p.sum(axis=0) + 1
        model = WeakModel(share / share.sum(), np.clip(new, 1e-4, 1 - 1e-4))
    return model


def _vector(m: Measures) -> tuple[np.ndarray, np.ndarray]:
    """Words and bytes by their share of the text; telling beginnings by presence, however long the
    text; shares as they are."""
    slot, n = np.unique(m.words, return_counts=True)
    x = np.sqrt(n.astype(np.float32))
    b = np.sqrt(m.bytes.astype(np.float32))
    at = np.flatnonzero(b)
    stems = np.unique(np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) % STEM_SLOTS for x in m.told], np.int64))
    there = np.flatnonzero(m.shares)
    values = (x / max(np.sqrt((x * x).sum()), 1e-9), 2 * b[at] / max(np.sqrt((b * b).sum()), 1e-9), np.full(len(stems), STEM / max(np.sqrt(len(stems)), 1.0)), 2 * m.shares[there])
    return np.r_[slot, SLOTS + at, SLOTS + 256 + stems, SIZE - SHARES + there], np.concatenate(values).astype(np.float32)


@dataclass
class Quality:
    weak: WeakModel
    weights: np.ndarray  # SIZE and a bias
    lexicon: frozenset[str] = frozenset()

    def score(self, m: Measures) -> float:
        at, x = _vector(m)
        return float(1 / (1 + np.exp(-np.clip((self.weights[at] * x).sum() + self.weights[-1], -30, 30))))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, known) of labels(doc_id, quality, toxic); nulls and other values say nothing, repeated rows the worst."""
    x = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("x"))
    known = F.when(F.col("x") == 1, TOXIC).when(F.col("q") == 0, POOR).when(F.col("q") == 1, GOOD)
    return x.select("doc_id", known.cast("int").alias("known")).filter("known is not null")


def toxic_beginnings(texts: DataFrame, known: DataFrame) -> frozenset[str]:
    """Word beginnings of toxic documents that others don't have, from LABELLED labelled documents of least id hash."""
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(x, k == TOXIC) for t, k in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in beginnings(word_set(lowered(t)))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([k for _, k in found], pa.bool_())], ["x", "bad"])

    # at most LABELLED rows of two numbers are broadcast
    seen = texts.join(F.broadcast(some), "doc_id").select("text", "known").mapInArrow(run, "x string, bad boolean")
    counted = seen.groupBy("x").agg(F.count_if("bad").alias("bad"), F.count("*").alias("n")).filter((F.col("bad") >= SUPPORT) & (F.col("bad") >= PURITY * F.col("n")))
    return frozenset(r.x for r in counted.orderBy(F.desc("bad"), "x").limit(STEMS).collect())


def _fit(row: np.ndarray, column: np.ndarray, x: np.ndarray, rows: int, columns: int, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic loss against the posteriors y, by accelerated gradient descent."""
    w, velocity, bias, vb = np.zeros(columns, np.float32), np.zeros(columns, np.float32), 0.0, 0.0
    if not columns:
        return w, bias
    # values by row and by column, so that sums run over slices; a row without values has the bias alone
    has, starts = np.unique(row, return_index=True)
    by_column = np.argsort(column, kind="stable")
    row2, x2 = row[by_column], x[by_column]
    starts2 = np.searchsorted(column[by_column], np.arange(columns))
    z = np.zeros(rows, np.float32)
    for _ in range(STEPS):
        z[has] = np.add.reduceat(w[column] * x, starts)
        g = ((1 / (1 + np.exp(-np.clip(z + bias, -30, 30))) - y) / rows).astype(np.float32)
        velocity = 0.9 * velocity + np.add.reduceat(g[row2] * x2, starts2) + DECAY * w
        vb = 0.9 * vb + float(g.sum())
        w -= RATE * velocity
        bias -= 0.1 * RATE * vb
    return w, bias


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> Quality:
    """Votes over all documents, accuracies from their pattern counts, scorer from at most `sample` documents.

    docs(text) and, with labels(doc_id, quality, toxic), doc_id. No documents give a model that scores every text 0.5.
    """
    bound_batches(spark)
    t = Tables(spark, "quality")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id") if labels is not None else F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = known_labels(labels) if labels is not None else None
    lexicon = toxic_beginnings(texts, known) if known is not None else frozenset()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pattern(measure(x, lexicon).votes) for x in b.column(1).to_pylist()], pa.int32())], ["doc_id", "p"])

    votes = t.save(texts.mapInArrow(vote, "doc_id long, p int"), "votes")
    # at most 3 ** labellers rows for each kind of label
    counts = {(r.p, UNKNOWN): r["count"] for r in votes.groupBy("p").count().collect()}
    total = sum(counts.values())
    if known is not None:
        for r in votes.join(known, "doc_id").groupBy("p", "known").count().collect():
            counts[r.p, r.known] = r["count"]
            counts[r.p, UNKNOWN] -= r["count"]
    t.drop("votes")
    weights = np.zeros(SIZE + 1, np.float32)
    if not total:
        return Quality(estimate(np.zeros(0, np.int64), np.zeros(0)), weights)
    key = np.array(list(counts), np.int64)
    weak = estimate(key[:, 0], np.array(list(counts.values()), float), key[:, 1])
    # hashes below the share wanted, half as many again; equal texts once; then exactly the smallest
    h = F.xxhash64("text", F.lit(23))
    below = -(2**63) + min(int(1.5 * sample / total * 2**64), 2**64 - 1)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ms = [measure(x, lexicon) for x in b.column(1).to_pylist()]
            vs = [_vector(m) for m in ms]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pattern(m.votes) for m in ms], pa.int32()), pa.array([a.astype("<i4").tobytes() for a, _ in vs], pa.binary()), pa.array([x.tobytes() for _, x in vs], pa.binary())], ["h", "p", "at", "x"])

    chosen = texts.select(h.alias("h"), "text").filter(F.col("h") <= below).dropDuplicates(["h"]).mapInArrow(featurize, "h long, p int, at binary, x binary")
    rows = sorted(chosen.toLocalIterator(), key=lambda r: (r.h, r.p))[:sample]
    if not rows:
        return Quality(weak, weights, lexicon)
    y = weak.posterior(np.array([r.p for r in rows]))
    at = [np.frombuffer(r.at, "<i4") for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(a) for a in at])
    at, x = np.concatenate(at), np.concatenate([np.frombuffer(r.x, np.float32) for r in rows])
    use = (np.bincount(at, minlength=SIZE) >= min(LEAST, len(rows)))[at]
    slots, column = np.unique(at[use], return_inverse=True)
    fitted, weights[-1] = _fit(row[use], column, x[use], len(rows), len(slots), y)
    weights[slots] = fitted
    return Quality(weak, weights, lexicon)


def classify(spark: SparkSession, docs: DataFrame, model: Quality | None = None, labels: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(row, posterior, score, abuse_words, keep) for every row of docs(text, ...); `row` is the whole input row.

    posterior is the weak-label model's, score the linear scorer's probability that a text is good. keep holds
    where score >= threshold and the text holds a word. Whole texts count; null and empty texts are scored as empty
    and not kept. Repeated rows get equal results; an empty table gives no rows.
    """
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model or train(spark, docs, labels))  # about 0.6 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            ms = [measure(t, q.lexicon) for t in b.column(1).to_pylist()]
            post = q.weak.posterior(np.array([pattern(m.votes) for m in ms], np.int64)) if ms else np.zeros(0)
            score = [q.score(m) for m in ms]
            keep = [s >= threshold and len(m.words) > 0 for s, m in zip(score, ms, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(post, pa.float64()), pa.array(score, pa.float64()), pa.array([m.abuse for m in ms], pa.int64()), pa.array(keep, pa.bool_())], ["row", "posterior", "score", "abuse_words", "keep"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("t"))
    schema = packed.select("row").schema.add("posterior", "double").add("score", "double").add("abuse_words", "long").add("keep", "boolean")
    return packed.mapInArrow(run, schema)
