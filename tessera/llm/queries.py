"""Queries of the ten training-data operators, with production parameters, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, html_extract, jaccard_join, language_id, mixing, packing, quality, stages, suffix_dedup, vector_search, warc
from .common import read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    kept = language_id.held_out(F.col("doc_id"))
    model = language_id.train(spark, docs.filter(~kept).select("doc_id", "text", "lang"))
    out = language_id.identify(spark, docs.select("doc_id", "text"), model)
    return out.select("doc_id", kept.alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(spark, read(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(spark, pages).select("page_id", "url", "text", "n_chars")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_bytes(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), length=50)
    return out.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(spark, docs, labels=read(spark, sf_dir, "labels")).select("row.doc_id", "posterior", "score", "abuse_words", "keep")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, read(spark, sf_dir, "documents"), stages.tokenizer_path(), capacity=2048, end=0)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_inner_products(spark, read(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprints.fingerprints(spark, read(spark, sf_dir, "documents"))
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return f.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), fingerprints.as_text(a).alias("fingerprint"), fingerprints.as_text(b).alias("edited_fingerprint"), fingerprints.resemblance(a, b).alias("near_edited"), fingerprints.resemblance(a, c).alias("near_next"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(spark, read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("row.doc_id", "size", "source_size", "target", "taken")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(spark, read(spark, sf_dir, "pages"))
    return warc.read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_ngram_jaccard_join, op3_html_extraction, op4_suffix_array_dedup, op5_quality_classifier, op6_best_fit_packing, op7_exact_top_k, op8_document_fingerprints, op9_source_mixing, op10_warc)}

ORACLES = {
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op10_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages
        ), g AS (SELECT h, max(page_id) AS keep FROM p GROUP BY h)
        SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
            list_reduce(list_transform(range(0, 32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    CAST((CAST('0x' || substr(p.h, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * CAST(i % 4 AS INTEGER))) & 31 AS INTEGER) + 1, 1)),
                lambda a, b: a || b) AS payload_digest,
            CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM p JOIN g USING (h)""",
}
