"""From raw documents to packed training sequences: five stages, each an operator of geoloom.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import discard, scratch_path
from geoloom.llm.decontaminate import decontaminated
from geoloom.llm.near_dedup import keep_one
from geoloom.llm.packing import packed
from geoloom.llm.quality_model import kept_by_quality
from geoloom.llm.secret_scan import redacted

TABLE = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject."""
    return kept_by_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(TABLE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 0.8 or more of the 5-word shingles of either are shared, decided on the shingles themselves."""
    return keep_one(docs, similarity=0.8, shingle=5).select(TABLE)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(TABLE)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars set anew."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(TABLE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens, with their token ids."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, size=4096, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", drop_low_quality),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secret scan", mask_secrets),
    ("packing", pack_sequences),
]

#: Fingerprints, a trained network and token packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and the one before it deleted."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            discard(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
