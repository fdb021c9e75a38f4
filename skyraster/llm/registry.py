"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, clustering, histogram_packing, license_library, licenses, mixing, packing, phrases, quality, secrets, sharding, simhash, topk, toxicity
from .common import read_table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(read_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal bytes of every source, as many bytes as the table has."""
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "source", "n_copies", "copy", "mix_key", "text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_digest(read_table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk_digest(read_table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"), license_library.library())


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(read_table(spark, sf_dir, "conversations"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustering_digest(read_table(spark, sf_dir, "embeddings"))


def op12_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_packing.pack_planned(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.best_phrases(phrases.phrases(read_table(spark, sf_dir, "documents")))


_QUERIES = [
    op1_secrets,
    op2_mixing,
    op3_packing,
    op4_quality,
    op5_simhash,
    op6_topk,
    op7_sharding,
    op8_toxicity,
    op9_licenses,
    op10_chat,
    op11_clustering,
    op12_histogram_packing,
    op13_phrases,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {}
