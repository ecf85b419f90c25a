"""Queries of the numbered operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantia.llm import (crf, decontaminate, katz, lattice, mixing, order_minhash, spelling, suffix_trees, token_counts, toxicity,
                          url_lists, wavelet, whitening)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pareto_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.pareto_mix(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "inclusion")


def op2_crf_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return crf.line_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_suffix_tree_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_trees.remove_repeats(_table(spark, folder, "documents"), with_text=False)
    return found.drop("kept_text")


def op4_classifier_chain_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_wavelet_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return wavelet.encode_and_read(_table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_temporal_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    found = url_lists.evaluate_captures(url_lists.dated_captures(pages), url_lists.events_from_pages(pages))
    return found.select("page_id", "host", "copies", "n_lists", "lists", "blocked")


def op7_two_tier_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_pigeonhole_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9_katz_backoff_scores(spark: SparkSession, folder: str) -> DataFrame:
    return katz.katz_scores(_table(spark, folder, "documents"))


def op10_order_minhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.near_duplicates(_table(spark, folder, "documents"))


def op11_bloom_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


def op12_lattice_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_vectors(_table(spark, folder, "embeddings"))


def op13_lanczos_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


QUERIES = {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}
