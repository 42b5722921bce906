"""A training corpus from raw documents in five stages, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mix_sources
from tessera.llm.packing import pack
from tessera.llm.quality_rules import quality_rules
from tessera.llm.queries import tokenizer_path
from tessera.llm.simhash import near_dedup


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns that stages read or write; all others pass through under neutral names, so none can clash.
USED = {"doc_id", "text", "source", "n_chars"}


def _apart(stage: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        plain = docs.toDF(*[c if c in USED else f"__x{i}" for i, c in enumerate(names)])
        return stage(spark, plain, sf_dir).select(*plain.columns).toDF(*names)

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


@_apart
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents whose posterior is against them, or that fail the base, go."""
    return quality_rules(docs, carry=docs.columns).filter("kept")


@_apart
def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: long lines of five or more documents stay in one of them; texts and their lengths change."""
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


@_apart
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: one document stays of each group within 2 bits of SimHash or with a five-word Jaccard similarity of 0.8 or more."""
    return near_dedup(docs, shingle=3, radius=2, similarity=0.8)


@_apart
def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document is there as often as its source's rate draws for it, in a global random order."""
    return mix_sources(docs, temperature=0.5)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path(), 2048)


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", own_lines),
    ("simhash_near_dedup", distinct_documents),
    ("source_mixing", mixed_documents),
    ("best_fit_packing", packed_sequences),
]

#: Packing needs a tokenizer and EM a loop; SQL has neither. tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
