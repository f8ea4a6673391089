"""Vector search and similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


#: Queries that meet a batch of vectors at once.
QUERY_BLOCK = 512


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k greatest scores with their ids, ties by the least id."""
    if scores.shape[1] > 4 * k:  # only what reaches the k-th score is sorted
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        width = int((scores >= least[:, None]).sum(1).max())
        if width < scores.shape[1]:
            at = np.argpartition(-scores, width - 1, axis=1)[:, :width]
            scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, metric: str = "ip", most_queries: int = 20_000) -> DataFrame:
    """``query_id, id, score, rank``: the k best of all vectors for each query, exactly; ``metric``: ip or l2 (the score is
    the squared distance, negated).

    The queries are counted first, as all of them meet every batch of vectors: beyond ``most_queries`` call in parts. Each
    task multiplies its vectors with the queries in Arrow batches and keeps k for each query, so what is shuffled are k rows
    a query and task. Ids are whole numbers; scores are compared to nine decimals, ties go to the least id; null vectors
    and those of another length than the queries' are left out.
    """
    rows = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vector_col)).limit(most_queries + 1).collect()
    if len(rows) > most_queries:
        raise ValueError(f"more than {most_queries} queries: pass them in parts")
    spark, schema = vectors.sparkSession, "query_id long, id long, score double"
    if not rows:
        return spark.createDataFrame([], schema + ", rank long")
    width = len(rows[0][1])
    kept = [r for r in rows if len(r[1]) == width]
    held = spark.sparkContext.broadcast((np.array([r[0] for r in kept], dtype=np.int64), np.array([r[1] for r in kept], dtype=np.float64)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = held.value
        top = [(np.full((len(part), 0), 0.0), np.full((len(part), 0), 0, dtype=np.int64)) for part in np.array_split(names, max(1, -(-len(names) // QUERY_BLOCK)))]
        blocks = np.array_split(matrix, len(top))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0), dtype=np.int64)
            v = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, width)
            for i, q in enumerate(blocks):
                scores = q @ v.T
                if metric != "ip":
                    scores = -np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * scores, 0.0)
                scores = np.concatenate([top[i][0], np.round(scores, 9)], axis=1)
                top[i] = _best(scores, np.concatenate([top[i][1], np.broadcast_to(ids, (len(q), len(ids)))], axis=1), k)
        for part, (scores, ids) in zip(np.array_split(names, len(top)), top):
            n = scores.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, n)), pa.array(ids.ravel()), pa.array(scores.ravel())], names=["query_id", "id", "score"])

    same = vectors.where(F.size(vector_col) == width).where(~F.exists(vector_col, lambda x: x.isNull()))
    local = same.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(best, schema)
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def mean_vectors(vectors: DataFrame, group: str, vector_col: str) -> DataFrame:
    """The mean vector of each group, built from sums by position (pre-aggregated)."""
    return (
        vectors.select(F.col(group).alias("group"), F.posexplode(vector_col).alias("pos", "x"))
        .groupBy("group", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("group")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"))
    )
