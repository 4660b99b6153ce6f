"""The queries of the operators in this subpackage, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from the labels that the contract leaves: doc_id, held_out, score, predicted."""
    from corpusloom.llm.quality_gam import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph and passage that repeats: doc_id, kind, first_word, n_words, component_id, kept. Documents without copies give no row."""
    from corpusloom.llm.paragraph_dedup import find_repeats

    return find_repeats(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document: doc_id, item_id, first_word, n_words, hamming, similarity. Clean documents give no row."""
    from corpusloom.llm.decontaminate import find_contamination

    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 2048: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    from corpusloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its entities replaced: doc_id, text, n_entities, entities. A null text stays null."""
    from corpusloom.llm.pii import pseudonymize

    return pseudonymize(_table(spark, sf_dir, "documents"), key="corpusloom")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after four edits, from stored trees: doc_id and counts. Null texts count as empty."""
    from corpusloom.llm.token_counts import count_edited, sample_edits

    return count_edited(sample_edits(_table(spark, sf_dir, "documents")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and notices: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    from corpusloom.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links within its label: vec_id, n_links, component_id, kept. Vectors that can't be compared link with nothing."""
    from corpusloom.llm.embedding_dedup import dedup_embeddings

    return dedup_embeddings(_table(spark, sf_dir, "embeddings"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies: doc_id, n_shingles, component_id. Documents without words link with nothing."""
    from corpusloom.llm.ngram_join import join_near

    return join_near(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets, plain and wrapped: doc_id, counts, base_sha256, spans. A null text counts as empty."""
    from corpusloom.llm.secret_scan import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document arranged for filling in its middle: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    from corpusloom.llm.fill_in_middle import digests, fill_in_middle

    return digests(fill_in_middle(_table(spark, sf_dir, "documents")))


def op12_hash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one: query_id, rank, vec_id, score."""
    from corpusloom.llm.hash_search import search

    vectors = _table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each lang diverge, by pairs and by terms: lang, source, part, item, value, rank."""
    from corpusloom.llm.source_audit import audit_sources

    return audit_sources(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii_surrogates, op2_token_counts, op3_license_scan, op4_quality_gam, op5_paragraph_dedup, op6_decontamination, op7_packing, op8_embedding_dedup, op9_ngram_join, op10_secret_scan, op11_fill_in_middle, op12_hash_search, op13_source_audit)}


def oracle_sql() -> dict[str, str]:
    from corpusloom.llm import fill_in_middle, license_scan, source_audit

    return {"op3_license_scan": license_scan.oracle(), "op11_fill_in_middle": fill_in_middle.oracle(), "op13_source_audit": source_audit.oracle()}
