"""Scans of the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
