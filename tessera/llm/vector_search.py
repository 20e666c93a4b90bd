"""Exact top-k inner-product search with vector-approximation files, block against block.

Candidates and queries are dealt into blocks. In each pair of blocks every candidate is approximated by the cell
of each component (a few bits). The cells give an upper and a lower bound of every score; candidates whose
upper bound is below the k-th lower bound are never read. The others are read in falling order of their upper
bound until the k-th exact score is above the next bound. The best k of every candidate block are then ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches

CELLS = 16
CANDIDATES, QUERIES = 8192, 1024


class Approximation:
    """Cells of integer vectors (rows of v): equal-width slices of each component's range in the block."""

    def __init__(self, v: np.ndarray, cells: int = CELLS):
        low, high = v.min(axis=0), v.max(axis=0)
        edges = low + np.ceil((high - low + 1) * np.arange(cells + 1)[:, None] / cells)  # (cells + 1, d)
        self.codes = np.stack([np.searchsorted(edges[1:-1, j], v[:, j], "right") for j in range(v.shape[1])], axis=1).astype(np.uint8)
        col = np.arange(v.shape[1])
        self.low, self.high = edges[self.codes, col], edges[self.codes + 1, col] - 1

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of each query's score with each vector."""
        up, down = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


def search(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of v for each query (fewer if there are fewer): query position, vector position, score."""
    va = Approximation(v)
    out: list[list[np.ndarray]] = [[], [], []]
    for a in range(0, len(q), 128):
        lows, highs = va.bounds(q[a : a + 128])
        for i in range(len(lows)):
            low, high = lows[i], highs[i].copy()
            own = ids == query_ids[a + i]
            high[own] = -np.inf
            usable = len(ids) - int(own.sum())
            if not usable:
                continue
            n = min(k, usable)
            sure = np.partition(np.where(own, -np.inf, low), len(low) - n)[len(low) - n]
            order = np.flatnonzero(high >= sure)
            order = order[np.argsort(-high[order], kind="stable")]
            got, score, at = order[:0], np.zeros(0, np.int64), 0
            while at < len(order) and (len(got) < n or high[order[at]] >= score[n - 1]):
                read = order[at : at + 64]
                at += len(read)
                got, score = np.r_[got, read], np.r_[score, v[read] @ q[a + i]]
                best = np.lexsort((ids[got], -score))[:n]
                got, score = got[best], score[best]
            for c, x in zip(out, (np.full(len(got), a + i), got, score), strict=True):
                c.append(x)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


def usable(c: Column) -> Column:
    """Neither null nor empty nor holding a null or non-finite component."""
    return F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def top_inner_products(spark: SparkSession, vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """The k best candidates of each query, exactly: query_id, rank (from 1), vec_id, score.

    vectors(vec_id, embedding) become integer vectors floor(scale * x). Queries are the rows whose vec_id is
    divisible by `every`; candidates are all rows of the same dimension with another vec_id. Ties go to the
    smaller vec_id. Null vectors and vectors with null or non-finite components or without any take no part,
    nor do rows with a null vec_id. Repeated rows count once. Components must keep scores below 2**53.
    Other columns are ignored; an empty table gives no rows.
    """
    bound_batches(spark)
    v = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")).distinct()
    v = v.withColumn("d", F.size("v"))
    n, nq = v.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, query_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-nq // QUERIES))
    item = F.collect_list(F.struct("vec_id", "v"))
    part = F.xxhash64("vec_id")
    cand = v.groupBy(F.pmod(part, F.lit(blocks)).alias("b"), "d").agg(item.alias("c"))
    query = v.filter(F.col("vec_id") % every == 0).groupBy(F.pmod(part, F.lit(query_blocks)).alias("qb"), "d").agg(item.alias("q"))
    pairs = query.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(cand, ["b", "d"]).select("q", "c")

    def unpack(x: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray]:
        s = x.slice(i, 1).flatten()
        ids = s.field("vec_id").to_numpy(zero_copy_only=False)
        return ids, s.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (qi, q), (ci, c) = unpack(b.column(0), i), unpack(b.column(1), i)
                at, got, score = search(ci, c, qi, q, k)
                yield pa.RecordBatch.from_arrays([pa.array(qi[at]), pa.array(ci[got]), pa.array(score)], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
