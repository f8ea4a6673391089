"""Queries of problem 2: noise in text from scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.scanned import Findings, repaired_table
from lattica.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return Findings(table(spark, folder, "kg_document")).cases().select(F.col("key").alias("document_id"), "field_name", "line_no", "kind")


def p2_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every body and abstract, those from scanned pages as continuous paragraphs."""
    return repaired_table(table(spark, folder, "kg_document"))


QUERIES = {"p2_found": p2_found, "p2_text": p2_text}
ORACLE: dict[str, str] = {}
