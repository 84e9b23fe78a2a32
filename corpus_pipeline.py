"""The corpus pipeline: documents in, the mix to train on out, stage by stage.

Each stage is a function of (session, documents, data folder); it is judged on its own input and its decisions take effect in its output.
Between stages the documents are written and read again, so a stage starts from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.decontamination import without_copies
from hearth.llm.jaccard_join import one_of_each
from hearth.llm.pii import redacted
from hearth.llm.source_mix import mix_sources
from hearth.llm.text import parked, table
from hearth.llm.toxicity import labelled, without_toxic

#: Classifiers and message passing are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the chain rejects go. Null and empty texts stay; rows that are equal fare alike; without labels all stay; an empty table stays empty."""
    return without_toxic(docs, *labelled(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the smallest id stays.

    Documents without a word (null and empty texts) all stay; a null id is the largest; of rows with equal id and text one stays.
    """
    return one_of_each(docs, width=5, pct=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go. Null and empty texts hold none; items of under 24 bytes, null and empty ones prove none; rows that are equal fare alike."""
    return without_copies(docs, table(spark, sf_dir, "benchmark"))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to tags; n_chars follows the text, and stays where the text is null. Empty texts stay as they are; no row goes."""
    clean = redacted(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: size and taken words of each, with the size and the target of its source.

    Null and empty texts have no words and are not taken; rows with equal id and source are taken alike; an empty table gives an empty mix.
    """
    return mix_sources(docs).filter("taken > 0")


STAGES = [
    ("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("decontamination", drop_benchmark), ("pii", hide_personal), ("source_mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = parked(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
