"""Packing of tokenised documents into sequences by patterns of lengths.

Only lengths decide a packing, so it is planned on their histogram, of at most `capacity` entries: patterns of
one to three lengths that fill a sequence (nearly) exactly are enumerated, repeat counts are fitted to the
histogram by non-negative least squares (projected coordinate descent), rounded down, and what is left is
packed by best fit on counts. A piece takes its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Tables, bound_batches

#: Least and most parts into which the pieces of one length are dealt, so that no task ranks a frequent length alone.
PARTS = (64, 1024)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LATIN, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
PIECE = re.compile(f"[{_LATIN}]+|[{_MARKS}]+")
#: What makes a word one that only the tokenizer cuts: other characters, and marks of special tokens.
ODD = re.compile(rf"[^{_LATIN}{_MARKS}\x20\x09-\x0D]|<\|")
KEPT, KEPT_CHARS, GROUP = 400_000, 8 << 20, 64
#: A tokenizer whose ids of this text are not those of its pieces gets whole texts.
PROBE = "Hello, World's (naïve) Straße\n\nx1  Y-z\tÀB don't <|a|> “q” 12,5 end. "


def patterns(hist: np.ndarray, slack: int = 0, third: int = 24) -> list[tuple[int, ...]]:
    """Few-document patterns over the lengths present: exact singles and pairs, and triples.

    hist[l] counts pieces of length l; the capacity is len(hist) - 1. Triples combine each of the `third` most
    frequent lengths with all pairs that complete it to at least capacity - slack.
    """
    cap = len(hist) - 1
    have = np.flatnonzero(hist[1:]) + 1
    out: list[tuple[int, ...]] = [(cap,)] if hist[cap] else []
    for gap in range(slack + 1):
        partner = cap - gap - have
        out += [(int(a), int(b)) for a, b in zip(have, partner, strict=True) if a >= b > 0 and hist[b]]
        for c in have[np.argsort(-hist[have], kind="stable")][:third]:
            rest = cap - gap - c - have
            out += [tuple(sorted((int(c), int(a), int(b)), reverse=True)) for a, b in zip(have, rest, strict=True) if a >= b > 0 and hist[b]]
    return list(dict.fromkeys(out))


def fit_counts(pats: list[tuple[int, ...]], hist: np.ndarray, sweeps: int = 12) -> np.ndarray:
    """Non-negative least squares of the histogram by pattern repeats, by projected coordinate descent."""
    x = np.zeros(len(pats))
    left = hist.astype(float)
    need = [np.unique(p, return_counts=True) for p in pats]
    for _ in range(sweeps):
        for j, (l, k) in enumerate(need):
            step = max(-x[j], float((left[l] * k).sum() / (k * k).sum()))
            x[j] += step
            left[l] -= step * k
    return x


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; together they hold every piece of the histogram exactly."""
    cap, left = len(hist) - 1, hist.astype(np.int64).copy()
    left[0] = 0
    out: dict[tuple[int, ...], int] = {}
    pats = patterns(left)
    # round down, largest fits first, never beyond what is there
    for j in np.argsort(-(x := fit_counts(pats, left)), kind="stable"):
        l, k = np.unique(pats[j], return_counts=True)
        times = min(int(x[j] + 1e-6), int((left[l] // k).min()))
        if times > 0:
            out[pats[j]] = out.get(pats[j], 0) + times
            left[l] -= times * k
    # residuals: best fit of falling lengths, on counts of equal open sequences
    room: dict[int, list[list]] = {}
    keys: list[int] = []
    for length in range(cap, 0, -1):
        n = int(left[length])
        while n:
            i = bisect.bisect_left(keys, length)
            had, times = room[keys[i]][-1] if i < len(keys) else ((), n)
            free = keys[i] if i < len(keys) else cap
            # the tightest sequence stays the tightest until it has no room for this length
            each = min(free // length, n)
            take = min(times, n // each)
            if i < len(keys):
                if times > take:
                    room[free][-1][1] -= take
                else:
                    room[free].pop()
                    if not room[free]:
                        del room[free], keys[i]
            had, after = (*had, *[length] * each), free - each * length
            if after:
                if after not in room:
                    room[after] = []
                    bisect.insort(keys, after)
                room[after].append([had, take])
            else:
                out[had] = out.get(had, 0) + take
            n -= each * take
    for groups in room.values():
        for had, times in groups:
            out[tuple(had)] = out.get(tuple(had), 0) + times
    return list(out.items())


def slots(planned: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Where the pieces of each length go: ranks from `first` on take sequences from `sequence` on, at `offset`."""
    rows, used, sequence = [], {}, 0
    for pattern, times in planned:
        at = 0
        for length in pattern:
            rows.append((length, used.get(length, 0), sequence, at, times))
            used[length] = used.get(length, 0) + times
            at += length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset", "times"])


class _Words:
    """Token ids of words, each encoded once: the tokenizer drops white space and never joins across it.

    Words of Latin letters and marks other than the apostrophe are further cut where letters and marks meet, as
    the tokenizer does. Two generations of about KEPT words or KEPT_CHARS characters are kept; what is used stays.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = 0
        parts = self.pieces(PROBE)
        self.learn(parts)
        self.whole = self.ids(parts) != self.encode(PROBE)

    def encode(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        """Token ids of a whole text."""
        if self.whole:
            return self.encode(text)
        parts = self.pieces(text)
        self.learn(parts)
        return self.ids(parts)

    def pieces(self, text: str) -> list[str]:
        if not ODD.search(text):
            return PIECE.findall(text.lower())
        out: list[str] = []
        for w in WORDS.findall(text):
            out += [w] if ODD.search(w) else PIECE.findall(w.lower())
        return out

    def learn(self, pieces: list[str]) -> None:
        missing = []
        for w in set(pieces).difference(self.new):
            self.chars += len(w)
            if (ids := self.old.get(w)) is not None:
                self.new[w] = ids
            else:
                missing.append(w)
        plain = [w for w in missing if not ODD.search(w)]
        for a in range(0, len(plain), GROUP):
            group = plain[a : a + GROUP]
            e = self.tok.encode(" ".join(group), add_special_tokens=False)
            ids, of = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids)
            cut = (4 * (np.flatnonzero(of[1:] != of[:-1]) + 1)).tolist()
            if len(cut) == len(group) - 1:
                self.new.update((w, ids[i:j]) for w, i, j in zip(group, [0, *cut], [*cut, len(ids)], strict=True))
            else:
                self._each(group)
        self._each([w for w in missing if ODD.search(w)])

    def _each(self, words: list[str]) -> None:
        for w in words:
            self.new[w] = self.encode(w)

    def ids(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.new.__getitem__, pieces))

    def age(self) -> None:
        if len(self.new) > KEPT or self.chars > KEPT_CHARS:
            self.old, self.new, self.chars = self.new, {}, 0


_KNOWN: dict[str, _Words] = {}


def _tokenize(tokenizer: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _KNOWN:
            _KNOWN[tokenizer] = _Words(tokenizer)
        known = _KNOWN[tokenizer]
        for b in batches:
            which, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = known.of(text or "") + int(end).to_bytes(4, "little")
                known.age()
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    which.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            rows = b.column(0).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["row", "piece", "start", "length", "ids_crc32"])

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Pieces of all docs(doc_id, text) with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids followed by `end`; only longer ones are cut, into pieces of `capacity`. Null and
    empty texts are the single id `end`. Repeated rows are documents of their own; rows with a null doc_id are
    packed under it. Other columns are ignored. Equal lengths are interchangeable and take their places by the
    order of doc_id, piece and crc. Sequences are gapless from offset 0. An empty table gives no rows.
    `tokenizer` is a path that executors can open. One that joins tokens across words or keeps capitals, as a probe
    shows, encodes whole texts instead of remembered words.
    """
    bound_batches(spark)
    t = Tables(spark, "packing")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = t.save(texts.mapInArrow(_tokenize(tokenizer, capacity, end), schema), "pieces")
    parts = min(PARTS[1], max(PARTS[0], int(spark.conf.get("spark.sql.shuffle.partitions"))))
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))
    pieces = pieces.withColumn("part", part)
    # at most capacity * parts counts
    counts = pieces.groupBy("length", "part").count().toPandas().sort_values(["length", "part"])
    hist = np.zeros(capacity + 1, np.int64)
    np.add.at(hist, counts["length"].to_numpy(), counts["count"].to_numpy())
    counts["before"] = counts.groupby("length")["count"].cumsum() - counts["count"]
    where = slots(plan(hist)).sort_values(["length", "first"])
    base = {(l, p): n for l, p, n in zip(counts["length"], counts["part"], counts["before"], strict=True)}
    table = {int(l): tuple(g[c].to_numpy() for c in ("first", "sequence", "offset")) for l, g in where.groupby("length")}
    shared = spark.sparkContext.broadcast((base, table))  # at most capacity * parts counts and the plan's slots

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, table = shared.value
        for b in batches:
            length, part, rank = (b.column(i).to_pylist() for i in (3, 5, 6))
            seq, off = [], []
            for l, p, r in zip(length, part, rank, strict=True):
                first, sequence, offset = table[l]
                rank_in_length = base[l, p] + r - 1
                k = int(np.searchsorted(first, rank_in_length, "right")) - 1
                seq.append(int(sequence[k]) + rank_in_length - int(first[k]))
                off.append(int(offset[k]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    w = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "part", F.row_number().over(w).cast("long").alias("rank"))
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")
