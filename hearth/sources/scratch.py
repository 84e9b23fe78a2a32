"""Intermediate results written to the cluster's shared checkpoint folder.

A result that is read several times is written once: later steps start from files that survive a lost executor,
and plans stay short.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


PACKED = "20.0"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only where all tasks run on this machine one of its own will do."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hearth-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/hearth-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written once and read back.

    Files are packed many times over, texts and keys above all. Spark is told so, or it would take a table of hundreds of MB for a small one and send it
    through the driver to every task.
    """
    path = new_folder(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.sources.fileCompressionFactor", PACKED)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
