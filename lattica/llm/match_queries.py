"""Queries of problem 1: matching papers and citation nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.matching import matches
from lattica.sources.tables import table


def _matches(spark: SparkSession, folder: str, least: float) -> DataFrame:
    return matches(table(spark, folder, "papers"), table(spark, folder, "crossref_metadata"), table(spark, folder, "citation_network_nodes"), least=least)


def p1_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair with the confidence that it is one work, if that is a hundredth at least."""
    return _matches(spark, folder, 0.01)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _matches(spark, folder, 0.5).select("paper_id", "node_id")


QUERIES = {"p1_found": p1_found, "p1_confidence": p1_confidence}
ORACLE: dict[str, str] = {}
