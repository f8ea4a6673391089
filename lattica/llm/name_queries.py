"""Queries of problem 3: variant spellings of names typed by people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.names import entities, linked_pairs
from lattica.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return linked_pairs(table(spark, folder, "crossref_metadata"))


def p3_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The entities with their number of mentions and of spellings."""
    mentions = table(spark, folder, "crossref_metadata")
    return (
        entities(mentions)
        .join(mentions.select("mention_id", "given", "family", "full_name"), "mention_id")
        .groupBy("entity")
        .agg(F.count("*").alias("mentions"), F.count_distinct(F.struct("given", "family", "full_name")).alias("spellings"))
    )


QUERIES = {"p3_found": p3_found, "p3_entities": p3_entities}
ORACLE: dict[str, str] = {}
