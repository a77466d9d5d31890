"""The corpus pipeline: language ID, exact dedup, near dedup, mixing to target weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossier.llm import exact_dedup, language_id, mixing, near_dedup, packing
from dossier.llm.common import new_path, stored, table
from dossier.llm.queries import WORD_BPE, crc_mod, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts; null, empty and letterless texts go."""
    return language_id.accepted(docs, language_id.learn(docs, crc_mod(4) != 2))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text."""
    index = exact_dedup.DigestIndex(spark, new_path(spark, "digest-index"))
    kept = exact_dedup.keep_first(docs, index)
    index.forget()
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each class of near copies."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered shares of sources, languages and topics."""
    return mixing.sample(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return packing.pack(packing.pieces(docs, tokenizer_path(WORD_BPE))).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The language and near-duplicate stages can't be stated in SQL; tests/llm holds every stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
