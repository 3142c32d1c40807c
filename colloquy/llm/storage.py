"""Intermediate tables in the folder that all executors of a cluster share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from colloquy.shared import shared_path


def spool(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: lineage is cut and a lost executor costs nothing."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
