"""Look-ups between tables: precedence unions, coalescing updates, resolution of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precedence_union(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``first``, and rows of ``second`` whose key it lacks (null keys of ``second`` stay)."""
    known = first.select(*keys).distinct()
    return first.unionByName(second.join(known, keys, "left_anti"), allowMissingColumns=True)


def updated(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], overwrite: bool = True) -> DataFrame:
    """Columns replaced by those of ``changes`` where it has the key and a value; else only nulls are filled."""
    named = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(named, keys, "left")
    pick = lambda c: F.coalesce(f"__{c}", c) if overwrite else F.coalesce(c, f"__{c}")
    return joined.withColumns({c: pick(c) for c in columns}).drop(*[f"__{c}" for c in columns])


def resolved_edges(events: DataFrame, ids: DataFrame, citing: str, cited: str, key: str, node: str) -> DataFrame:
    """``source, target`` of events whose two keys are both known, each once."""
    one = lambda c, n: ids.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(c)).agg(F.min(node).alias(n))
    return events.join(one(citing, "source"), citing).join(one(cited, "target"), cited).select("source", "target").distinct()


def common_citers(edges: DataFrame, left: str, right: str, field: str = "field", citing: str = "source", cited: str = "target") -> DataFrame:
    """Works cited from both fields: their citers' numbers and the citers themselves, ';'-joined in order."""
    distinct = edges.where(F.col(field).isin(left, right)).select(field, citing, cited).where(F.col(cited).isNotNull() & F.col(citing).isNotNull()).distinct()
    side = lambda f, name: (
        distinct.where(F.col(field) == f)
        .groupBy(cited)
        .agg(F.count("*").alias(f"{name}_count"), F.array_join(F.array_sort(F.collect_list(F.col(citing))), ";").alias(f"{name}_citers"))
    )
    return side(left, "left").join(side(right, "right"), cited)
