"""Queries of the training-data operators: thin digests over the operators, each on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .mixing import mix_sources
from .packing import pack
from .pii import find_pii
from .pii_rules import KINDS
from .quality_model import quality_scores
from .quality_rules import quality_rules
from .sharding import vector_shards
from .simhash import simhash_groups
from .toxicity import toxicity_scores


def tokenizer_path() -> str:
    """The place of the public byte-level BPE file on this machine; operators take any other path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vector_shards(table(spark, sf_dir, "documents"), 16)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mix_sources(table(spark, sf_dir, "documents"), temperature=0.5, carry=["doc_id", "source", "text"])
    return d.select("doc_id", "source", "n_copies", "copy", F.round("mean_rate", 6).alias("mean_rate"), F.round("shuffle_key", 12).alias("shuffle_key"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    d = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(~third))
    return d.select("doc_id", F.coalesce(third, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find_pii(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform("base", lambda s: s.kind)
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_scores(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "score", (F.col("score") >= 0.5).alias("kept"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_vector_sharding": op1_vector_sharding,
        "op2_quality_rules": op2_quality_rules,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_source_mixing": op4_source_mixing,
        "op5_toxicity": op5_toxicity,
        "op6_simhash_pivots": op6_simhash_pivots,
        "op7_line_dedup": op7_line_dedup,
        "op8_pii": op8_pii,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_quality_model": op10_quality_model,
    }
