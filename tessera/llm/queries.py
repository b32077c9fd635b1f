"""The thin queries that apply each operator to its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, licences
from tessera.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.bpe import roundtrip_digests

    return roundtrip_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"))


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


def op5_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat import rendered_conversations

    return rendered_conversations(table(spark, sf_dir, "conversations"))


def op6_tiff_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import stage
    from tessera.llm.tiff import media_digests, stored

    return media_digests(stage(stored(table(spark, sf_dir, "documents")), "tiff"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language import held_out, identify, learn

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.vectors import nearest

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0))


def op9_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licences import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_bpe_roundtrip": op2_bpe_roundtrip,
    "op3_line_chunk_dedup": op3_line_chunk_dedup,
    "op4_pii_spans": op4_pii_spans,
    "op5_chat_snapshots": op5_chat_snapshots,
    "op6_tiff_columns": op6_tiff_columns,
    "op7_language_id": op7_language_id,
    "op8_vantage_point_search": op8_vantage_point_search,
    "op9_setsketch_near_duplicates": op9_setsketch_near_duplicates,
    "op10_license_digests": op10_license_digests,
}
ORACLE_SQL: dict[str, str] = {"op5_chat_snapshots": chat.ORACLE, "op10_license_digests": licences.oracle()}
