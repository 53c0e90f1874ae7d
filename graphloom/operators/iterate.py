"""Cutting lineage in iterative plans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder (``spark.checkpoint.dir``; a local default only where none is set)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/graphloom-checkpoints")
    return df.checkpoint(eager=True)
