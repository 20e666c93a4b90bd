"""Bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct hashes of a text's w-word shingles. Sketches of parts
merge into the sketch of the whole; two of them estimate resemblance and containment, one the distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, words

K = 128
#: Most range splitters kept as literals; beyond them ranges are cut into equal-width parts.
SPLITTERS = 256


def shingle_sketch(text: Column, k: int = K, width: int = 5) -> Column:
    """Bottom-k sketch of a text; with fewer words than `width` all of them are one shingle, without any it is empty."""

    def sketch(x: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(x) - (width - 1), F.lit(1)))
        hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(x, i + (j - 1)) for j in range(width)]))
        return F.when(F.size(x) == 0, F.array().cast("array<long>")).otherwise(F.slice(F.sort_array(F.array_distinct(hashes)), 1, k))

    return bound(words(ascii_lower(text)), sketch)


def bound(value: Column, body) -> Column:
    """body(value) with the value evaluated once: a lambda inside body would evaluate a plain column again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; exact while the union has at most k shingles; two empty sets are equal."""
    shared = F.array_intersect(a, b)
    return bound(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, shared)) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: (k - 1) over the k-th smallest hash's share; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too (an empty a is contained in all)."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(both / distinct_shingles(a, k), F.lit(1.0)))


def as_text(a: Column) -> Column:
    """Lowercase hex of a sketch, 16 digits a hash; empty for an empty sketch."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def merge_parts(df: DataFrame, key: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """Sketch of each key from the sketches of its parts: (key, sketch).

    The k smallest distinct hashes of each salted part of a key come first, so a key with most of the rows is
    spread over many tasks and a final group holds at most parts * k hashes. Null sketches count as empty.
    """
    salted = df.select(F.col(key), F.explode(F.col(sketch)).alias("h"), F.pmod(F.xxhash64(F.col(sketch)), F.lit(64)).alias("salt")).distinct()
    for by in ([key, "salt"], [key]):
        w = Window.partitionBy(*by).orderBy("h")
        salted = salted.withColumn("r", F.dense_rank().over(w)).filter(F.col("r") <= k).drop("r")
    hashed = salted.groupBy(key).agg(F.slice(F.sort_array(F.collect_set("h")), 1, k).alias(sketch))
    keys = df.select(key).distinct()
    return keys.join(hashed, keys[key].eqNullSafe(hashed[key]), "left").select(keys[key], F.coalesce(hashed[sketch], F.array().cast("array<long>")).alias(sketch))


def with_next(spark: SparkSession, rows: DataFrame, key: str, carry: list[str], made: dict[str, Column] | None = None) -> DataFrame:
    """Each row and the `carry` and `made` columns of the next row by (key, carry) as next_<column>; the first follows
    the last. `made` columns are computed once a row, where it has been placed, so they don't travel.

    Rows are cut into key ranges, each ordered in its own task; the first row of each range also goes to the
    range before it. A range holds at most a splitter's share of the rows, unless one key has more of them.
    """
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    coarse = min(parts, SPLITTERS)
    cut = rows.select(F.percentile_approx(key, [i / coarse for i in range(1, coarse)] or [0.5], 10_000).alias("s"), F.min(key).alias("a"), F.max(key).alias("z")).first()
    if cut.a is None:
        splits, fine = [], 1
    else:
        splits, fine = sorted(set(cut.s)) if coarse > 1 else [], -(-parts // coarse)
    at = F.size(F.filter(F.array(*[F.lit(int(x)).cast("long") for x in splits]).cast("array<long>"), lambda s: s < F.col(key))) if splits else F.lit(0)
    bucket = F.when(F.col(key).isNull(), F.lit(0)).otherwise(at).cast("long")
    if fine > 1:
        low = [cut.a, *splits]
        high = [*splits, cut.z]
        left, right = (F.array(*[F.lit(int(x)).cast("long") for x in v]) for v in (low, high))
        i = at + 1
        share = (F.col(key) - F.element_at(left, i)) / F.greatest(F.element_at(right, i) - F.element_at(left, i), F.lit(1))
        bucket = bucket * fine + F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.least(F.floor(share * fine), F.lit(fine - 1)).cast("long"))
    placed = rows.withColumn("_bucket", bucket).withColumn("_ghost", F.lit(0))
    own = [F.col(c) for c in (key, *carry)]
    # the first row of each range: one row a range, pre-aggregated
    firsts = placed.groupBy("_bucket").agg(F.min(F.struct(*own)).alias("f"))
    # as many rows as ranges; in one task they find the range before theirs
    before = F.lag("_bucket").over(Window.orderBy("_bucket"))
    final = F.max("_bucket").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ghosts = firsts.withColumn("_to", F.coalesce(before, final)).withColumn("_ghost", F.lit(1))
    rest = [c for c in rows.columns if c not in (key, *carry)]
    ghosts = ghosts.select(*[F.col(f"f.{c}").alias(c) for c in (key, *carry)], *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rest], F.col("_to").alias("_bucket"), "_ghost")
    both = placed.unionByName(ghosts).repartition(parts, "_bucket").withColumns(made or {})
    w = Window.partitionBy("_bucket").orderBy("_ghost", *own)
    return both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in (*carry, *(made or {}))]).filter("_ghost = 0").drop("_ghost", "_bucket")


def fingerprints(spark: SparkSession, docs: DataFrame, k: int = K, width: int = 5) -> DataFrame:
    """Sketches of every text, of its edited text and of the next document's text.

    Returns doc_id, n_chars, edited_text, sketch, edited_sketch, next_sketch. The edited text has its last
    floor(n_chars / 4) code points replaced by as many first ones (or all) of the next document by ascending
    (doc_id, text), after the last the first. Null texts are empty. Repeated doc_ids follow each other by text;
    null doc_ids come first. A single document is its own next. An empty table gives no rows; other columns
    are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    near = with_next(spark, own, "doc_id", ["text"], {"sketch": shingle_sketch(F.col("text"), k, width)})
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    near = near.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)).alias("edited_text"), "sketch", F.col("next_sketch"))
    return near.withColumn("edited_sketch", shingle_sketch(F.col("edited_text"), k, width))
