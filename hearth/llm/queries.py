"""The named queries of the text operators with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.byte_repeats import byte_repeats
from hearth.llm.chat_format import chat_format, format_digest
from hearth.llm.chat_format import comparison_sql as chat_sql
from hearth.llm.decontamination import decontamination
from hearth.llm.jaccard_join import jaccard_join
from hearth.llm.language_id import language_id
from hearth.llm.merkle_manifest import comparison_sql as merkle_sql
from hearth.llm.merkle_manifest import merkle_manifest, tampered
from hearth.llm.pii import KINDS, pii_spans
from hearth.llm.quality_rules import quality_rules
from hearth.llm.source_mix import comparison_sql as mix_sql
from hearth.llm.source_mix import mix_sources
from hearth.llm.text import table
from hearth.llm.token_alignment import token_alignment
from hearth.llm.token_counts import token_counts
from hearth.llm.toxicity import labelled, toxicity
from hearth.llm.word_repeats import word_repeats


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    train = docs.filter(~held_out).select(F.col("doc_id").alias("id"), "text", "lang")
    found = language_id(docs, train)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_repeats(table(spark, sf_dir, "documents"), with_kept=False)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, *labelled(docs, table(spark, sf_dir, "labels")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op10_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_repeats(table(spark, sf_dir, "documents"), with_kept=False)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle_manifest(docs, tampered(docs))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(probe))
    return format_digest(chat_format(rows.union(added)))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_decontamination, op2_language_id, op3_quality_rules, op4_pii, op5_word_repeats, op6_jaccard_join, op7_source_mix, op8_toxicity,
        op9_token_counts, op10_byte_repeats, op11_token_alignment, op12_merkle_manifest, op13_chat_format,
    )
    return {f.__name__: f for f in found}


def llm_sql() -> dict[str, str]:
    return {"op7_source_mix": mix_sql(), "op12_merkle_manifest": merkle_sql(), "op13_chat_format": chat_sql()}
