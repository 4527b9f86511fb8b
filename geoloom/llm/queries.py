"""The queries of this subpackage, by name: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import fp_hex, near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, bits=64, radius=3)
    return found.select("doc_id", fp_hex("fp").alias("fingerprint"), "component_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    found = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start", "words")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import written_and_read

    return written_and_read(_table(spark, sf_dir, "documents"), _tokenizer(), end_id=1)


def op5_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(_table(spark, sf_dir, "documents"), _tokenizer(), end_id=2, size=4096)


def op6_format_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_digests

    return secret_digests(_table(spark, sf_dir, "documents"))


def op7_tree_scored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extracted

    return extracted(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import without_repeats

    return without_repeats(_table(spark, sf_dir, "documents"), size=35, with_text=False)


def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op10_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import balanced_shards

    return balanced_shards(_table(spark, sf_dir, "documents"), shards=24)


def op11_shifted_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .curve_search import nearest_vectors

    return nearest_vectors(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resampled

    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


def op13_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def queries() -> dict:
    """Every query of this subpackage."""
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """The same results in DuckDB SQL, where SQL can say it over whole tables."""
    from .oracles import ORACLES

    return dict(ORACLES)
