"""Answering a question over the graph: entry points, traversal, ranking, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.graph import collected_edges
from lattica.operators.triples import document_frequency

#: Terms of one question; a bound on what is broadcast.
MOST_TERMS = 10_000


def substring_entries(names: DataFrame, terms: DataFrame, name: str = "entity_name", term: str = "term") -> DataFrame:
    """``term, entity_name``: names that hold a term, whatever the case. The terms are those of questions: bounded."""
    few = terms.select(F.col(term).alias("term")).where(F.trim(term) != "").distinct().limit(MOST_TERMS + 1)
    if few.count() > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: pass them in parts")
    distinct = names.select(F.col(name).alias("entity_name")).where(F.col(name).isNotNull()).distinct()
    listed = F.broadcast(few.agg(F.collect_list("term").alias("terms")))
    low = F.lower("entity_name")
    hits = F.filter("terms", lambda t: F.contains(low, F.lower(t)))
    return distinct.join(listed).select(F.explode(hits).alias("term"), "entity_name")


def ranked_triples(triples: DataFrame, entries: DataFrame, k: int = 2, most: int = 20, documents: int = 5, tie: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The triples of the most frequent documents near the entries, and these documents.

    Triples are collected along out-edges within k steps; documents are ranked by their triples (ties by id); triples
    by their document's rank, their depth and their text, then by the columns ``tie``.
    """
    near = collected_edges(triples, entries, k, "entity_name", "h", "t")
    top = document_frequency(near).orderBy(F.desc("n"), "document_id").limit(documents)
    kept = near.withColumn("document_id", F.coalesce("document_id", F.lit(""))).join(F.broadcast(top), "document_id")
    return kept.orderBy(F.desc("n"), "document_id", "depth", "h", "r", "t", *tie).limit(most), top


def context(triples: DataFrame, documents: DataFrame, question: Column, template: str, order: list[str], most: int = 10, most_documents: int = 5) -> DataFrame:
    """``prompt``: the template with the first triples, the documents they come from, and the question put in.
    ``documents``: document_id, title, text; those with most of the triples come first."""
    rows = triples.orderBy(*order).limit(most)
    lines = rows.agg(F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.format_string("%s | %s | %s", "h", "r", "t").alias("line")))).alias("x"))
    lines = lines.select(F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("facts"))
    top = rows.groupBy("document_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "document_id").limit(most_documents)
    texts = documents.join(F.broadcast(top), "document_id").select(F.struct((-F.col("n")).alias("n"), "document_id", F.concat_ws("\n", "title", "text").alias("t")).alias("x"))
    texts = texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("texts"))
    parts = (("{context}", F.concat_ws("\n\n", F.nullif("facts", F.lit("")), F.nullif("texts", F.lit("")))), ("{query}", question))
    prompt = F.lit(template)
    for mark, value in parts:
        prompt = F.replace(prompt, F.lit(mark), value)
    return lines.crossJoin(F.broadcast(texts)).select(prompt.alias("prompt"))  # one row each
