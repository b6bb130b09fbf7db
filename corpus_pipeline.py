"""The corpus pipeline: quality, near-duplicates, secrets, mixing, packing.

Every stage takes documents with any columns besides its own, whatever their names, and nulls in any of them: a null text is read as an
empty one and stays null; rows without an id are kept, and are never the reason why another row goes; rows that repeat an id are one
document to the near-duplicate stage, and as many rows to the others. Empty tables give empty tables. All but the last stage return the
columns that they got, in their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import mixing, neardup, packing, quality, secretscan
from strandlake.llm.common import stored, table
from strandlake.llm.registry import common_words, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the corpus. Equal texts stay or go together; empty ones are scored too."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; texts without words are in no group."""
    return neardup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars, where there is one, follows the text (null of a null text). No row goes."""
    clean = secretscan.redacted(docs, words=common_words())
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document once for each time the mix takes it: within a source by a shuffle of ids, equal ids together."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place; a text without tokens is its end id. Equal rows are packed one by one."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_gam", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL has neither the classifier nor the tokenizer; the pipeline is tested against its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
