"""Stages of the corpus pipeline; each takes (spark, docs, sf_dir) and returns documents, the last one pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, mixing, packing, suffix_dedup
from . import quality as weak
from .common import read

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, trained on docs themselves and the labels of the folder, if any."""
    labels = read(spark, sf_dir, "labels") if sf_dir else None
    return weak.classify(spark, docs, labels=labels).filter("keep").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8): the one of smallest doc_id.

    Rows are told apart by doc_id and text, so another text under the id of a dropped row stays; of repeated rows one
    stays. Rows without words or without an id all stay.
    """
    found = jaccard_join.jaccard_components(spark, docs, k=5, percent=80).filter("n_shingles > 0 and doc_id is not null")
    rows = found.groupBy("doc_id", "text_key", "component").agg((F.count("*") > 1).alias("again"))
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("kept"))
    gone = rows.join(first, "component").select("doc_id", "text_key", "again", (F.struct("doc_id", "text_key") != F.col("kept")).alias("gone")).filter("gone or again")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    left = own.join(gone, ["doc_id", "text_key"], "left").filter("not coalesce(gone, false)")
    one = left.filter("again").dropDuplicates(["doc_id", "text_key"])
    return left.filter("again is null").select("row.*").union(one.select("row.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes or more that a document of a smaller id has too.

    Code points cut by a removed string go with it; n_chars is counted anew. Texts that lose all their words go.
    """
    out = suffix_dedup.repeated_bytes(spark, docs, length=50)
    left = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("�"), F.lit("")))
    out = out.select("row", "n_removed", left.alias("left")).filter("n_removed = 0 or left rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    cols = {"text": F.col("left"), "n_chars": F.char_length("left").cast("long")}
    return out.select(*[cols[c].alias(c) if c in cols else F.col(f"row.`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    out = mixing.mixed(spark, docs).filter("copies > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(spark, docs, tokenizer_path())
