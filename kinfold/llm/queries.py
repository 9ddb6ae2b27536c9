"""The queries of this subpackage for ``__spark_entry__``; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm._base import read
from kinfold.session import ship


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.substring_dedup import dedup_substrings

    return dedup_substrings(read(spark, sf_dir, "documents"), window=50)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.quality_classifier import classify

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, read(spark, sf_dir, "labels"), threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.jaccard_join import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), size=5, percent=80)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.secret_scan import digest, scan_secrets

    return digest(scan_secrets(read(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.decontamination import find_benchmark

    found = find_benchmark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kinfold.llm.best_fit_packing import pack

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.html_extraction import extract

    return extract(read(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.license_scan import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.nearest_neighbours import nearest

    return nearest(read(spark, sf_dir, "embeddings"), k=20, every=20)


def op10_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.llm.katz_lm import score

    return score(read(spark, sf_dir, "documents"), folds=7, held_out=2)


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(ship(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _shipped(f) for k, f in globals().items() if k.startswith("op")}
