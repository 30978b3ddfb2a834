"""Registered queries of the corpus operators and their DuckDB check statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (byte_pairs, clustering, decontaminate, hilbert, html_text, minhash, packing, quality, rollup, scratch,
               surrogates, toxicity, whitening)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), size=2, percent=80)


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data."""
    return surrogates.pseudonymise(_read(spark, sf_dir, "documents"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 runs of a Hilbert curve."""
    return hilbert.shards(_read(spark, sf_dir, "documents"), 16)


def op3_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items."""
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    judged = quality.rules(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return judged.drop("text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.rate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 words."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer after three batches over all documents."""
    return rollup.replay(_read(spark, sf_dir, "documents"), scratch.new_path(spark, "rollup"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the bytes decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_pairs.digests(byte_pairs.round_trip(_read(spark, sf_dir, "documents"), path))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings along 16 whitened principal components."""
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 clusters of all 64-dimensional embeddings after three rounds."""
    return clustering.clusters(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_surrogates": op1_surrogates,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op3_contaminated": op3_contaminated,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_token_rollup": op9_token_rollup,
    "op10_main_text": op10_main_text,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_whitening": op12_whitening,
    "op13_bisector_clusters": op13_bisector_clusters,
}

STATEMENTS: dict[str, str] = {
    "op2_hilbert_shards": hilbert.statement(),
    "op3_contaminated": decontaminate.statement(),
    "op9_token_rollup": rollup.STATEMENT,
    "op13_bisector_clusters": clustering.statement(),
}
