"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprints, html_extract, kd_clustering, langid, lexical_search, oracles, packing, pii, quality, secret_scan, simhash_dedup, suffix_dedup, tokens
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", simhash_dedup.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page and each document; page_id or doc_id says which."""
    docs = table(spark, sf_dir, "documents")
    texts = langid.learn(docs, sample_rows=4000)
    of_pages = langid.identify_pages(table(spark, sf_dir, "pages"), texts).withColumn("doc_id", F.lit(None).cast("long"))
    of_docs = langid.identify_documents(docs, texts).withColumn("page_id", F.lit(None).cast("long"))
    return of_docs.unionByName(of_pages)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"), sample_rows=2000)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), max_edits=0.2, recall=0.99)


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limit=2048)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), size=1024, end_id=2)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), accept=0.7, sample_rows=6000)


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), length=50)
    n_bytes, kept = F.octet_length("text").cast("long"), F.octet_length("kept").cast("long")
    return found.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = kd_clustering.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5)
    return kd_clustering.with_inertia(found, centroids).withColumnRenamed("id", "vec_id")


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_document_fingerprints, op3_language_id, op4_html_extraction, op5_benchmark_decontamination, op6_token_counts, op7_pii, op8_secret_scan, op9_best_fit_packing, op10_quality_classifier, op11_suffix_array_dedup, op12_centroid_clustering, op13_ranked_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {"op11_suffix_array_dedup": oracles.REPEATS, "op12_centroid_clustering": oracles.clusters(), "op13_ranked_lexical_search": oracles.SEARCH}
