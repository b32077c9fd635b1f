"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as Parquet; its decisions take effect. All but the last return the
columns of ``documents``; where a stage changes texts, ``n_chars`` follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stage, table
from tessera.llm.language import in_known_language, learn
from tessera.llm.lines import dedup_lines
from tessera.llm.near_duplicates import kept_documents
from tessera.llm.packing import packed_documents
from tessera.llm.pii import redact
from tessera.llm.queries import vocabulary


def _measured(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    size = F.length("text").cast(like.schema["n_chars"].dataType)
    return docs.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; those without letters or in none of them go, and a missing ``lang`` is filled in."""
    return in_known_language(docs, learn(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; documents of which nothing is left go."""
    return _measured(dedup_lines(docs).filter(F.col("text").rlike(r"\S")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return kept_documents(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind."""
    return _measured(redact(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024 tokens."""
    return packed_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("PII", pii), ("best-fit packing", packing)]

#: The stages are no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
