"""Queries of problems 6, 7 and 8: tokens, containers and shared spans of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.packing import packed
from lattica.llm.shared_spans import shared_chars, shared_spans
from lattica.llm.tokenize import counted, decoded, encoded
from lattica.session import written
from lattica.sources.tables import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"))


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The texts decoded from their ids: an exact round trip."""
    return decoded(written(encoded(table(spark, folder, "documents")), "ids"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each document, or piece of one, for each context window."""
    sizes = written(counted(table(spark, folder, "documents")), "sizes")
    return packed(sizes, table(spark, folder, "context_window"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per context window: documents, containers, tokens and how full the containers are."""
    return (
        p7_containers(spark, folder)
        .groupBy("window_name", "container")
        .agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("piece") == 0).alias("docs"))
        .groupBy("window_name")
        .agg(F.count("*").alias("containers"), F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"))
        .join(F.broadcast(table(spark, folder, "context_window")), "window_name")
        .withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4))
    )


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Per context window: documents packed, containers above the capacity, and documents whose pieces lost a token."""
    sizes = written(counted(table(spark, folder, "documents")), "sizes")
    windows = table(spark, folder, "context_window")
    pieces = written(packed(sizes, windows), "pieces")
    loads = pieces.groupBy("window_name", "container").agg(F.sum("tokens").alias("load")).join(F.broadcast(windows), "window_name")
    overfull = loads.groupBy("window_name").agg(F.count_if(F.col("load") > F.col("capacity_tokens")).alias("overfull"))
    kept = pieces.groupBy("window_name", "doc_id").agg(F.sum("tokens").alias("held")).join(sizes, "doc_id")
    return kept.groupBy("window_name").agg(F.count("*").alias("docs"), F.count_if(F.col("held") != F.col("tokens")).alias("lossy")).join(overfull, "window_name")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_chars(table(spark, folder, "documents"))


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The maximal shared intervals themselves."""
    return shared_spans(table(spark, folder, "documents"))


QUERIES = {
    "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_kept": p7_kept,
    "p8_found": p8_found, "p8_spans": p8_spans,
}
ORACLE = {
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p7_kept": "select window_name, count(*) docs, 0 lossy, 0 overfull from documents, context_window group by 1",
}
