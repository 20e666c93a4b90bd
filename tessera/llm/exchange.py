"""Which hashes of one block do other blocks have? Packed questions to buckets, one byte in answer for each hash.

A block is a row that holds some megabytes of texts. It sends its distinct 64-bit hashes, sorted, as one packed row
for each bucket; a bucket counts in how many blocks each is and answers with a code for each, in the order it was
asked. Beside the bucket 32 bits of a hash are sent, so a code may count a clash too: it tells what may be shared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of packed rows in one Arrow batch.
BATCH = 4 << 20
ASKED = "bucket int, block long, hashes binary"
SAID = "bucket int, block long, codes binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def squeeze(x: bytes) -> bytes:
    return zstandard.compress(x, 1)


def unsqueeze(x: bytes) -> bytes:
    return zstandard.decompress(x)


def edges(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new.nonzero()[0]


def gaps(cut: np.ndarray, end: int) -> np.ndarray:
    """Sizes of the runs that begin at these places; the last one ends at `end`."""
    out = np.empty(len(cut), np.int64)
    np.subtract(cut[1:], cut[:-1], out=out[:-1])
    out[-1:] = end - cut[-1:]
    return out


def spans(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of equal values, half open."""
    cut = edges(x).tolist()
    return zip(cut, [*cut[1:], len(x)][: len(cut)], strict=True)


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split() for c in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(cols, names, strict=True)], [n for n, _ in names])


def batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some megabytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(x) for x in r if isinstance(x, bytes))
        if size >= BATCH:
            yield batch(held, schema)
            held, size = [], 0
    if held:
        yield batch(held, schema)


def cells(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in b.columns), strict=True)


def _rest(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key // np.uint64(buckets)).astype("<u4")


def asked(key: np.ndarray, block: int, buckets: int) -> Iterator[tuple]:
    """Rows of ASKED for sorted distinct hashes. The bytes go by place: sorted, the high ones compress away."""
    part = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    for a, e in spans(part[order]):
        rest = _rest(key[order[a:e]], buckets)
        yield int(part[order[a]]), block, squeeze(np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 4).T).tobytes())


def _answers(code: Callable[[np.ndarray], np.ndarray]):
    def of_bucket(bucket: int, held: list[tuple[int, bytes]]) -> Iterator[tuple]:
        keys = [np.frombuffer(unsqueeze(x), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for _, x in held]
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        num = np.diff(edges(key[order]), append=len(key))
        codes = np.empty(len(key), np.uint8)
        codes[order] = np.repeat(code(num).astype(np.uint8), num)
        for (block, _), f in zip(held, np.split(codes, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
            if f.any():
                yield bucket, block, squeeze(f.tobytes())

    def rows(got: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held = None, []
        for b in got:
            for bucket, block, hashes in cells(b):
                if bucket != now:
                    if held:
                        yield from of_bucket(now, held)
                    now, held = bucket, []
                held.append((block, hashes))
        if held:
            yield from of_bucket(now, held)

    return lambda got: batches(rows(got), SAID)


def codes_of(known: np.ndarray, answers: list[dict] | None, buckets: int) -> np.ndarray:
    """The code of each of a block's sorted distinct hashes; 0 where the buckets said nothing."""
    out = np.zeros(len(known), np.uint8)
    if answers:
        part = (known % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        begin = np.searchsorted(part[order], np.array([a["bucket"] for a in answers]))
        for i, a in zip(begin.tolist(), answers, strict=True):
            f = np.frombuffer(unsqueeze(a["codes"]), np.uint8)
            out[order[i : i + len(f)]] = f
    return out


def compared(blocks: DataFrame, ask: Callable, code: Callable[[np.ndarray], np.ndarray], tasks: int) -> DataFrame:
    """`blocks` (block, ...) and answers, list of (bucket, codes). ask makes rows of ASKED of them; code turns the
    number of blocks that have a hash into a byte, 0 for one that is alone."""
    said = blocks.mapInArrow(ask, ASKED).repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_answers(code), SAID)
    return blocks.join(said.groupBy("block").agg(F.collect_list(F.struct("bucket", "codes")).alias("answers")), "block", "left")
