"""Removal of byte strings that repeat across documents, by suffix arrays built with linear grouping.

A byte is removed when a LENGTH-byte string covering it also starts in a document with a smaller doc_id. Whether
two strings are equal is always read off the suffix order of grouping_sort, whose neighbours are compared byte by
byte. Hashes only find regions that may repeat and decide which of them meet in one task; a clash of hashes makes
a task look at more, never remove more, and equal strings always have equal hashes.

1. Anchors. Each LENGTH-byte string selects the K-byte string of smallest hash inside it, so equal strings select
   equal anchors. Blocks of documents send their anchors' hashes and get back those that another block has too.
   Starts whose anchor no other document has go no further; the others lie in regions. Short anchors come first, as
   they are few; regions that stay are asked about by longer ones, which end close to where a repeat ends.
2. Chunks. Content-defined cuts split regions; a chunk carries the LENGTH-1 bytes after it, so each string starts in
   exactly one. Chunks that begin with the same string are suffix-sorted together, first those of one block, then
   what is left in the task of their bucket; what is left of those meets once more with all that ends in the same
   string. So equal chunks meet, and so do the parts before and after an edit. A start is marked when a smaller
   document has its string; the smallest document's copy is never marked, and only unmarked runs go on.
3. Windows. Of what is left, nearly distinct by now, anchors are compared once more. Strings of one anchor
   occurrence that is still shared form a window; windows of equal anchors are suffix-sorted together, again
   within the block first. Many different windows of one anchor are split into their strings, which are sorted by
   content, so a frequent anchor is shared out.
4. Marked runs go back to their documents, which drop the covered bytes.

A group too large for one sort is sorted in slices of rising doc_id, carrying the unmarked ones; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, bound_batches, mix
from .exchange import ASKED, asked, batches, cells, codes_of, compared, edges, spans, squeeze, unsqueeze
from .grouping_sort import equal_runs, ranges

#: Bytes of text that a map task gathers before it sorts and sends, and bytes of one suffix sort.
FLUSH = 4 << 20
SORT = 3 << 19
#: Small sets are sorted STEP of their size at once, LEAST_SORT bytes at least, which fit the processor's cache.
LEAST_SORT, STEP = 1 << 18, 512
#: Places whose least hashes are made together, so that they stay in the processor's cache.
TILE = 1 << 14
#: One position in so many ends a chunk; a chunk without one is cut at the limit.
CUT = 128
LONGEST = 2048
#: Bytes of a short anchor; by how many a long one is shorter than a string; bytes of text for each bucket.
SHORT, LESS = 16, 10
BUCKET_BYTES = 8 << 20
#: More different windows than this (or blocks that hold the anchor) are split into single strings.
SPLIT = 128

SENT = "bucket int, kind int, block long, rk long, meta binary, text binary"
MARKS = "doc_id long, rk long, runs binary"
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Strings(NamedTuple):
    """Strings of one buffer: where each starts, its size, the key under which it meets others, and its owner."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    key: np.ndarray
    doc: np.ndarray
    rk: np.ndarray
    pos: np.ndarray

    def take(self, at: np.ndarray) -> Strings:
        return Strings(self.data, *(c[at] for c in self[1:]))

    def compact(self) -> Strings:
        """The same strings over a buffer that holds nothing else."""
        return Strings(self.data[ranges(self.start, self.size)], np.cumsum(self.size) - self.size, *self[2:])

    def packed(self) -> tuple[bytes, bytes]:
        """Meta and text. Owners are listed once and keys are left out: the reader makes them from the text."""
        s = self.take(np.lexsort((self.pos, self.rk, self.doc)))
        new = np.flatnonzero(np.r_[True, (s.doc[1:] != s.doc[:-1]) | (s.rk[1:] != s.rk[:-1])][: len(s.doc)])
        own = np.diff(new, append=len(s.doc))
        step = np.diff(s.pos, prepend=0)
        meta = np.concatenate([[len(new), len(s.doc)], s.doc[new], s.rk[new], own, step, s.size])
        return squeeze(meta.astype("<i8").tobytes()), squeeze(s.data[ranges(s.start, s.size)].tobytes())


def unpacked(rows: list[tuple[bytes, bytes]], keys=None) -> Strings:
    """Strings of packed rows; keys makes their keys of (data, start, size)."""
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for m, _ in rows:
        x = np.frombuffer(unsqueeze(m), "<i8")
        k, n = int(x[0]), int(x[1])
        doc, rk, own, step, size = np.split(x[2:], [k, 2 * k, 3 * k, 3 * k + n])
        for c, v in zip(cols, (np.repeat(doc, own), np.repeat(rk, own), np.cumsum(step), size), strict=True):
            c.append(v)
    doc, rk, pos, size = (np.concatenate(c) for c in cols)
    data = np.frombuffer(b"".join(unsqueeze(t) for _, t in rows), np.uint8)
    start = np.cumsum(size) - size
    return Strings(data, start, size, keys(data, start, size) if keys else np.zeros(len(size), np.uint64), doc, rk, pos)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the end."""
    return np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def _string_keys(x: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the length-byte string at each of these places; x: eights."""
    h = np.full(len(at), length, np.uint64)
    for o in dict.fromkeys([*range(0, length - 7, 8), length - 8]):
        h = mix(h + x[at + o] * _C[0])
    return h


def _chunk_keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each string from its eight-byte pieces, in any order."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(_eights(data) * _C[1]), dtype=np.uint64)])
    return mix(total[start + size - 7] - total[start] + size.astype(np.uint64))


def _least(data: np.ndarray, length: int, k: int) -> np.ndarray:
    """For every place the least hash of the k-byte strings inside the length-byte string that starts there."""
    x = _eights(data)
    out = np.empty(max(0, len(data) - length + 1), np.uint64)
    for a in range(0, len(out), TILE):
        e = min(a + TILE, len(out))
        h = np.zeros(e - a + length - k, np.uint64)
        for i, o in enumerate(dict.fromkeys([*range(0, k - 7, 8), k - 8])):
            h += x[a + o : a + o + len(h)] * _C[i % 4]
            h ^= h >> np.uint64(32)
            h *= _C[(i + 2) % 4]
        w, span = length - k + 1, 1
        while 2 * span <= w:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        np.minimum(h[: e - a], h[w - span :], out=out[a:e])
    return out


def _window_keys(length: int, k: int):
    return lambda data, start, size: _least(data, length, k)[start]


def _head_keys(length: int):
    return lambda data, start, size: _string_keys(_eights(data), start, length)


def _tail_keys(length: int):
    return lambda data, start, size: _string_keys(_eights(data), start + size - length, length)


class Runs:
    """Marked runs of starts, [first, last + 1) in the coordinates of their rows."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []

    def add(self, doc: np.ndarray, rk: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
        if len(doc):
            self.held.append((doc, rk, first, end))

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        """One row for each document: its runs, joined where they touch."""
        if not self.held:
            return
        doc, rk, first, end = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held = []
        order = np.lexsort((first, rk, doc))
        doc, rk, first, end = doc[order], rk[order], first[order], end[order]
        other = np.r_[True, (doc[1:] != doc[:-1]) | (rk[1:] != rk[:-1])]
        far = np.cumsum(other) * (int(end.max()) + 1)  # keeps rows apart
        new = np.flatnonzero(other | np.r_[True, (far + first)[1:] > np.maximum.accumulate(far + end)[:-1]])
        runs = np.stack([first[new], np.maximum.reduceat(end, new)], axis=1).astype("<i8")
        cut = np.flatnonzero(other[new])
        for a, e in zip(cut.tolist(), [*cut[1:].tolist(), len(new)], strict=True):
            yield int(doc[new[a]]), int(rk[new[a]]), runs[a:e].tobytes()


def _joined(parts: list[Strings]) -> Strings:
    """Strings of one buffer together."""
    return Strings(parts[0].data, *(np.concatenate(c) for c in zip(*(p[1:] for p in parts), strict=True)))


def _judge_block(s: Strings, length: int, runs: Runs) -> Strings:
    """Sort strings that lie by key, note the starts that a smaller doc has too; the runs of starts that are left."""
    text = s.data[ranges(s.start, s.size)]
    base = np.cumsum(s.size) - s.size
    own = np.repeat(np.arange(len(s.size)), s.size)
    order, run = equal_runs(text, s.size, np.cumsum(np.r_[0, s.key[1:] != s.key[:-1]]), length)
    doc = s.doc[own[order]]
    hit = doc > np.minimum.reduceat(doc, edges(run))[run]
    pieces = []
    for places in (order[hit], order[~hit]):  # the last places of a string start no string, so runs stay inside
        mark = np.zeros(len(text) + 1, bool)
        mark[places] = True
        edge = np.flatnonzero(np.diff(mark[:-1], prepend=False, append=False))
        pieces.append((own[edge[::2]], edge[::2], edge[1::2]))
    (at, a, e), (left, f, z) = pieces
    runs.add(s.doc[at], s.rk[at], s.pos[at] + a - base[at], s.pos[at] + e - base[at])
    return Strings(s.data, s.start[left] + f - base[left], z - f + length - 1, s.key[left], s.doc[left], s.rk[left], s.pos[left] + f - base[left])


def judge(s: Strings, length: int, runs: Runs) -> Strings:
    """Strings of equal keys meet; what is left of them, as runs of unmarked starts."""
    s = s.take(np.lexsort((s.doc, s.key)))
    cut = edges(s.key)
    if not len(cut):
        return s
    several = np.minimum.reduceat(s.doc, cut) != np.maximum.reduceat(s.doc, cut)
    num = np.diff(cut, append=len(s.key))
    met = np.repeat(several, num)
    out, todo = [s.take(~met)], np.flatnonzero(met)
    # sets of like size are sorted together, as the largest one sets the number of steps; small ones take few at once
    set_size = np.repeat(np.add.reduceat(s.size, cut), num)
    todo = todo[np.argsort(set_size[todo], kind="stable")]
    firsts = np.zeros(len(s.key), bool)
    firsts[cut] = True
    ends = np.cumsum(s.size[todo])
    at = 0
    while at < len(todo):
        most = min(SORT, max(LEAST_SORT, STEP * int(set_size[todo[at]])))
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        if to < len(todo):
            whole = np.flatnonzero(firsts[todo[at + 1 : to + 1]])
            to = at + 1 + int(whole[-1]) if len(whole) else to
        part = s.take(todo[at:to])
        while to < len(todo) and not firsts[todo[to]]:  # a set larger than one sort: carry what is left
            part = _judge_block(part, length, runs)
            more = max(to + 1, int(np.searchsorted(ends, ends[to - 1] + max(SORT, 2 * int(part.size.sum())), "right")))
            after = np.flatnonzero(firsts[todo[to:more]])
            more = to + int(after[0]) if len(after) else more
            part, to = _joined([part, s.take(todo[to:more])]), more
        out.append(_judge_block(part, length, runs))
        at = to
    return _joined(out)


def frequent(s: Strings) -> np.ndarray:
    """Which windows have a key with more than SPLIT different ones."""
    if not len(s.key):
        return np.zeros(0, bool)
    look = _chunk_keys(s.data, s.start, s.size)
    order = np.lexsort((look, s.key))
    new = np.r_[True, s.key[order][1:] != s.key[order][:-1]][: len(order)]
    kinds = np.cumsum(new | np.r_[True, look[order][1:] != look[order][:-1]][: len(order)])
    cut = np.flatnonzero(new)
    many = np.diff(kinds[cut], append=kinds[-1:] + 1) > SPLIT
    out = np.zeros(len(s.key), bool)
    out[order] = np.repeat(many, np.diff(cut, append=len(order)))
    return out


def singles(s: Strings, length: int) -> Strings:
    """The strings of windows one by one, each under its own hash."""
    n = s.size - length + 1
    start = ranges(s.start, n)
    own = np.repeat(np.arange(len(n)), n)
    return Strings(s.data, start, np.full(len(start), length), _string_keys(_eights(s.data), start, length), s.doc[own], s.rk[own], s.pos[own] + start - s.start[own])


def judge_windows(s: Strings, length: int, runs: Runs) -> None:
    """Marks of windows that go no further."""
    many = frequent(s)
    judge(s.take(~many), length, runs)
    judge(singles(s.take(many), length), length, runs)


def _sent(s: Strings, buckets: int, kind: int) -> Iterator[tuple]:
    bucket = ((s.key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for a, e in spans(bucket[order]):
        yield int(bucket[order[a]]), kind, None, None, *s.take(order[a:e]).packed()


def _mark_rows(runs: Runs, buckets: int) -> Iterator[tuple]:
    """Marks travel beside texts: block is the doc_id, text the runs."""
    for doc, rk, data in runs.rows():
        yield rk % buckets, 1, doc, rk, None, data


def _documents(length: int):
    """Blocks of whole texts that are long enough; a block's number is unique, not the same in every run."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        task, made = TaskContext.get().partitionId() << 32, 0
        held, total = [], 0

        def block() -> tuple:
            data = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
            size = np.array([len(t) for _, _, t in held])
            none = np.zeros(len(held), np.int64)
            return 0, 0, task + made, None, *Strings(data, np.cumsum(size) - size, size, none.view(np.uint64), *(np.array([h[i] for h in held]) for i in (0, 1)), none).packed()

        for b in batches:
            for doc, rk, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if doc is None or len(raw) < length:
                    continue
                held.append((doc, rk, raw))
                total += len(raw)
                if total >= FLUSH:
                    yield block()
                    held, total, made = [], 0, made + 1
        if held:
            yield block()

    return lambda got: batches(rows(got), SENT)


def _regions(length: int, buckets: int, k: int):
    """Blocks of the regions whose short anchors another document may have."""

    def rows(got: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in got:
            for block, meta, text, answers in cells(b):
                s = unpacked([(meta, text)])
                start, own, _, hit = _hits(s, length, answers, buckets, k)
                edge = _cut(own, hit)
                n = np.diff(edge, append=len(own))
                edge, n = edge[hit[edge]], n[hit[edge]]
                of, at = own[edge], start[edge]
                if len(edge):
                    yield 0, 0, block, None, *Strings(s.data, at, n + length - 1, s.key[of], s.doc[of], s.rk[of], s.pos[of] + at - s.start[of]).packed()

    return lambda got: batches(rows(got), SENT)


def _chunks(length: int, anchor_buckets: int, buckets: int, k: int):
    """Chunks of what may repeat, by the bucket of their hash; the block's own repeats are settled first."""

    def rows(got: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in got:
            for _, meta, text, answers in cells(b):
                s = unpacked([(meta, text)])
                start, own, _, hit = _hits(s, length, answers, anchor_buckets, k)
                cut = (_eights(s.data)[start] * _C[0]) >> np.uint64(40) < (1 << 24) // CUT
                edge = np.union1d(_cut(own, hit), np.flatnonzero(cut))
                n = np.diff(edge, append=len(start))
                edge, n = edge[hit[edge]], n[hit[edge]]
                # the few that are too long go in even pieces
                parts = -(-n // LONGEST)
                piece = ranges(np.zeros(len(n), np.int64), parts)
                edge, n = np.repeat(edge, parts) + piece * LONGEST, np.minimum(LONGEST, np.repeat(n, parts) - piece * LONGEST)
                at, size, of = start[edge], n + length - 1, own[edge]
                runs = Runs()
                yield from _sent(judge(Strings(s.data, at, size, _head_keys(length)(s.data, at, size), s.doc[of], s.rk[of], s.pos[of] + at - s.start[of]), length, runs), buckets, 0)
                yield from _mark_rows(runs, buckets)

    return lambda got: batches(rows(got), SENT)


def _by_bucket(got: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple[bytes, bytes]]], list[tuple]]]:
    """Rows sorted by bucket, a bucket at a time: its texts by kind and its marks."""
    now, texts, marks = None, {}, []
    for b in got:
        for bucket, kind, block, rk, meta, text in cells(b):
            if bucket != now:
                if now is not None:
                    yield now, texts, marks
                now, texts, marks = bucket, {0: [], 2: []}, []
            if kind != 1:
                texts[kind].append((meta, text))
            else:
                marks.append((bucket, kind, block, rk, meta, text))
    if now is not None:
        yield now, texts, marks


def _by_head(length: int, buckets: int):
    """Chunks that begin alike meet; what is left goes on by the bucket of its end."""

    def rows(got: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, texts, marks in _by_bucket(got):
            yield from marks
            if texts[0]:
                runs = Runs()
                left = judge(unpacked(texts[0], _head_keys(length)), length, runs)
                yield from _sent(left._replace(key=_tail_keys(length)(left.data, left.start, left.size)), buckets, 0)
                yield from _mark_rows(runs, buckets)

    return lambda got: batches(rows(got), SENT)


def _by_tail(length: int, buckets: int):
    """Chunks that end alike meet; what is left goes on in blocks."""

    def rows(got: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for bucket, texts, marks in _by_bucket(got):
            yield from marks
            if not texts[0]:
                continue
            runs = Runs()
            left = judge(unpacked(texts[0], _tail_keys(length)), length, runs)
            yield from _mark_rows(runs, buckets)
            ends = np.cumsum(left.size)
            for i, at in enumerate(np.split(np.arange(len(left.size)), np.searchsorted(ends, np.arange(FLUSH, int(ends[-1]), FLUSH))) if len(ends) else ()):
                if len(at):
                    yield bucket, 0, bucket << 24 | i, None, *left.take(at).packed()

    return lambda got: batches(rows(got), SENT)


def _anchors(s: Strings, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings of a block: where they start, the hash of their anchor, and the text they are in."""
    n = s.size - length + 1
    start = ranges(s.start, n)
    return start, _least(s.data, length, k)[start], np.repeat(np.arange(len(n)), n)


def _cut(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns changes."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _ask(length: int, buckets: int, k: int):
    """Distinct anchors of each block."""

    def rows(got: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in got:
            for block, meta, text in cells(b):
                key = _anchors(unpacked([(meta, text)]), length, k)[1]
                key = np.sort(key[edges(key)])
                yield from asked(key[edges(key)], block, buckets)

    return lambda got: batches(rows(got), ASKED)


def _shared_code(num: np.ndarray) -> np.ndarray:
    """0 for an anchor of one block, 2 for one of many."""
    return (num > 1).astype(np.uint8) + (num > SPLIT)


def _hits(s: Strings, length: int, answers: list[dict] | None, buckets: int, k: int) -> tuple[np.ndarray, ...]:
    """Of all strings of a block: where they start, the text they are in, what the buckets said of the anchor (0: no
    other block has it, 2: many have), and whether another document may have the string."""
    start, key, own = _anchors(s, length, k)
    first = _cut(key, own)
    num = np.diff(first, append=len(key))
    known, back = np.unique(key[first], return_inverse=True)
    flag = codes_of(known, answers, buckets)
    doc = s.doc[own[first]]
    low = np.full(len(known), np.iinfo(np.int64).max)
    high = np.full(len(known), np.iinfo(np.int64).min)
    np.minimum.at(low, back, doc)
    np.maximum.at(high, back, doc)
    hit = (flag > 0) | (low != high)
    return start, own, np.repeat(flag[back], num), np.repeat(hit[back], num)


def _windows(length: int, anchor_buckets: int, buckets: int, k: int, short: int):
    """Windows of the starts whose anchor another document may have; the block's own repeats are settled first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for _, meta, text, answers in cells(b):
                s = unpacked([(meta, text)])
                start, own, flag, hit = _hits(s, length, answers, anchor_buckets, k)
                key = _least(s.data, length, short)[start]
                edge = _cut(key, own, flag, hit)
                size = np.diff(edge, append=len(start)) + length - 1
                edge, size = edge[hit[edge]], size[hit[edge]]
                of = own[edge]
                win = Strings(s.data, start[edge], size, key[edge], s.doc[of], s.rk[of], s.pos[of] + start[edge] - s.start[of])
                said = flag[edge]
                runs = Runs()
                judge_windows(win.take(said == 0).compact(), length, runs)
                some = win.take(said == 1).compact()
                many = frequent(some)
                yield from _sent(some.take(many), buckets, 0)
                yield from _sent(judge(some.take(~many), length, runs), buckets, 0)
                often = np.flatnonzero(said == 2)
                for i in range(0, len(often), 4096):
                    yield from _sent(judge(singles(win.take(often[i : i + 4096]), length), length, runs), buckets, 2)
                yield from _mark_rows(runs, buckets)

    return lambda got: batches(rows(got), SENT)


def _meet(length: int, k: int):
    """Windows of one anchor meet; marks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, texts, marks in _by_bucket(batches):
            for _, _, doc, rk, _, data in marks:
                yield doc, rk, data
            runs = Runs()
            if texts[0]:
                judge_windows(unpacked(texts[0], _window_keys(length, k)), length, runs)
            if texts[2]:
                judge(unpacked(texts[2], _head_keys(length)), length, runs)
            yield from runs.rows()

    return lambda got: batches(rows(got), MARKS)


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, spans, kept = [], [], [], []
            for text, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                n.append(len(raw))
                if not marks:
                    removed.append(0)
                    spans.append([])
                    kept.append(raw)
                    continue
                cover = np.zeros(len(raw) + 1, np.int64)
                runs = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
                np.add.at(cover, runs[:, 0], 1)
                np.add.at(cover, runs[:, 1] + length - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                removed.append(int(gone.sum()))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["row", "n_bytes", "n_removed", "spans", "kept"])

    return run


def marked(spark: SparkSession, t: Tables, texts: DataFrame, length: int) -> DataFrame:
    """Marked runs (doc_id, rk, runs) of texts(doc_id, rk, text); t holds the intermediate tables."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 * BUCKET_BYTES)))
    buckets = tasks

    short = min(SHORT, length - 8)
    long = max(short, length - LESS)
    names = ("block", "meta", "text")

    def dealt(x: DataFrame) -> DataFrame:
        return x.repartition(tasks, "bucket").sortWithinPartitions("bucket")

    whole = t.save(texts.mapInArrow(_documents(length), SENT).select(*names), "documents")
    known = compared(whole, _ask(length, buckets, short), _shared_code, tasks).select(*names, "answers")
    regions = t.save(known.mapInArrow(_regions(length, buckets, short), SENT).select(*names), "regions")
    del known, whole
    t.drop("documents")
    t.release()
    known = compared(regions, _ask(length, buckets, long), _shared_code, tasks).select(*names, "answers")
    chunks = dealt(known.mapInArrow(_chunks(length, buckets, buckets, long), SENT)).mapInArrow(_by_head(length, buckets), SENT)
    blocks = t.save(dealt(chunks).mapInArrow(_by_tail(length, buckets), SENT), "blocks")
    del known, regions, chunks
    t.drop("regions")
    t.release()
    known = compared(blocks.filter("kind = 0").select(*names), _ask(length, buckets, long), _shared_code, tasks).select(*names, "answers")
    marks = dealt(known.mapInArrow(_windows(length, buckets, buckets, long, short), SENT)).mapInArrow(_meet(length, short), MARKS)
    early = blocks.filter("kind = 1").select(F.col("block").alias("doc_id"), "rk", F.col("text").alias("runs"))
    out = t.save(early.union(marks), "marks")
    del known, marks, early, blocks
    t.drop("blocks")
    t.release()
    return out


def repeated_bytes(spark: SparkSession, docs: DataFrame, length: int = 50) -> DataFrame:
    """(row, n_bytes, n_removed, spans, kept) for every row of docs(doc_id, text, ...).

    `row` is the whole input row as one struct, so no column of it can clash; spans are (start, end) in bytes and
    kept is binary. A byte of the UTF-8 text goes when a length-byte string that covers it also starts in a
    document with a smaller doc_id; strings are judged on the input. Null and empty texts have 0 bytes. Texts
    shorter than `length` are kept whole. Rows with a null doc_id are kept whole and count for no other row.
    Repeated doc_ids are equal, not smaller, so they do not remove each other. An empty table gives no rows.
    length is 16 at least.
    """
    assert length >= 16
    bound_batches(spark)
    t = Tables(spark, "suffix")
    text = F.col("text").cast("string")
    key = F.xxhash64(text)  # tells rows of one doc_id apart
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("rk"), text.alias("text"))
    marks = marked(spark, t, texts, length).groupBy("doc_id", "rk").agg(F.collect_list("runs").alias("marks"))
    # rows without a doc_id are shared out by their text and match nothing
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), key).alias("doc_id"), key.alias("rk"), F.col("doc_id").isNull().alias("loose"))
    joined = own.join(marks.withColumn("loose", F.lit(False)), ["doc_id", "rk", "loose"], "left").select("row", "text", "marks")
    span = T.StructType().add("start", "long").add("end", "long")
    schema = joined.select("row").schema.add("n_bytes", "long").add("n_removed", "long").add("spans", T.ArrayType(span)).add("kept", "binary")
    return joined.mapInArrow(_remove(length), schema)
