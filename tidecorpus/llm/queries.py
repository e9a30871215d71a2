"""One thin query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, collocations, fingerprint, license_scan, mixing, neardup, packing, quality, secret_scan, token_count, toolcalls, toxicity
from .common import held_out, table

BPE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is drawn under the production weights."""
    docs = table(spark, sf_dir, "documents").withColumn("domain", mixing.domain_of())
    return mixing.draw(docs, **mixing.PRODUCTION).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _classified(scored: DataFrame, at: float) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return _classified(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.5)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return _classified(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    out = packing.pack(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, 2048, 0, keep_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram pieces of every document."""
    docs = table(spark, sf_dir, "documents")
    return token_count.with_counts(docs, public_tokenizers.path(PIECE_FILE)).select("doc_id", "n_tokens")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of every conversation, linked, ordered, validated and serialised."""
    return toolcalls.link(*toolcalls.from_turns(table(spark, sf_dir, "conversations")), toolcalls.TOOLS)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and the documents within 3 bits."""
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and covered licence templates of every document."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (4-word shingles, 4 bits)."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", neardup.hex64(F.col("fingerprint")).alias("fingerprint"), "component_id", "links")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' findings of every document and the spans that the network adds, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.fit(docs.where(~held_out()))))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of every language."""
    return collocations.top(collocations.mine(table(spark, sf_dir, "documents"), min_count=30, max_words=4), 2000)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector after ten rounds of eight centroids."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)[0]


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_counts": op4_token_counts,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_license_scan": op9_license_scan,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_secret_scan": op11_secret_scan,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES: dict[str, str] = {"op1_mix_sources": mixing.oracle_sql(), "op7_chat_formatting": toolcalls.oracle_sql(), "op12_phrase_collocations": collocations.oracle_sql(), "op13_centroid_clustering": centroids.oracle_sql()}
