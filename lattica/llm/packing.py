"""Filling containers of fixed capacity with documents, the attention cost spread evenly.

An item longer than the capacity is cut into full containers and a rest; everything else stays whole. Items are dealt
to shards of bounded size by a hash, and each shard is packed by itself, so no task sees more than a shard and what is
lost to sharding is at most one part-filled container for each. Within a shard, items go in descending order to the
open sequence of the lowest cost that has room; only where none has, a new sequence is opened. The cost of an item of n
tokens is ``n + quadratic * n * n``: the work linear in tokens and the attention within the item.

Defined cases: null and negative sizes count as 0; items of size 0 get a container like others; ties go by id, then to
the sequence opened first; every row gives a row, repeated and null ids included, and is an item of its own (rows are
numbered, so neither shards nor containers depend on ids); capacities below 1 and null ones give none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Items in a shard, about.
SHARD_ITEMS = 4000
#: Windows of one call; they travel with every item, so more are refused.
MOST_WINDOWS = 1000
#: Weight of the quadratic part: at 2048 tokens attention costs half as much as the linear work.
QUADRATIC = 1 / 4096


def fill(sizes: np.ndarray, capacity: int, quadratic: float = QUADRATIC) -> np.ndarray:
    """The sequence of each item; ``sizes`` in descending order, none above the capacity."""
    n, opened = len(sizes), 0
    room, cost, out = np.full(n, capacity, dtype=np.int64), np.zeros(n), np.empty(n, dtype=np.int64)
    for i, size in enumerate(sizes):
        fits = np.flatnonzero(room[:opened] >= size)
        if len(fits):
            at = fits[np.argmin(cost[fits])]
        else:
            at, opened = opened, opened + 1
        room[at] -= size
        cost[at] += size + quadratic * float(size) * float(size)
        out[i] = at
    return out


def packed(
    items: DataFrame, windows: DataFrame, id_col: str = "doc_id", size_col: str = "tokens", name_col: str = "window_name",
    capacity_col: str = "capacity_tokens", shard_items: int = SHARD_ITEMS, quadratic: float = QUADRATIC,
) -> DataFrame:
    """``window_name, doc_id, piece, tokens, container`` for each item and window. ``windows`` is a small fixed table."""
    id_type = items.schema[id_col].dataType
    sized = items.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    shards = max(1, math.ceil(items.count() / shard_items))
    capacities = windows.select(F.col(name_col).alias("window_name"), F.col(capacity_col).cast("long").alias("capacity")).where("capacity > 0")
    # every item goes into each window: a join with the fixed list of windows held in each row, not a cross join of tables
    listed = capacities.distinct().orderBy("capacity", "window_name").limit(MOST_WINDOWS + 1).collect()
    if len(listed) > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} windows: pass them in parts")
    windows_column = F.array(*[F.struct(F.lit(r.window_name).alias("window_name"), F.lit(r.capacity).alias("capacity")) for r in listed])
    if not listed:
        windows_column = F.array().cast("array<struct<window_name:string,capacity:bigint>>")
    pieces = sized.select("doc_id", "size", "row", F.inline(windows_column)).withColumn(
        "whole", F.when(F.col("size") > F.col("capacity"), F.floor(F.col("size") / F.col("capacity"))).otherwise(0)
    )
    full = pieces.where("whole > 0").select(
        "window_name", "doc_id", "row", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1)).alias("piece"), F.col("capacity").alias("tokens")
    ).withColumn("container", F.concat_ws("-", F.lit("d"), F.col("row").cast("string"), "piece")).drop("row")
    rest = pieces.where((F.col("whole") == 0) | (F.col("size") % F.col("capacity") > 0)).select(
        "window_name", "capacity", "doc_id", F.col("whole").cast("int").alias("piece"),
        (F.col("size") - F.col("whole") * F.col("capacity")).alias("tokens"), F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"),
    )
    schema = T.StructType(
        [
            T.StructField("window_name", T.StringType()),
            T.StructField("doc_id", id_type),
            T.StructField("piece", T.IntegerType()),
            T.StructField("tokens", T.LongType()),
            T.StructField("container", T.StringType()),
        ]
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        at = fill(pdf["tokens"].to_numpy(dtype=np.int64), int(pdf["capacity"].iloc[0]), quadratic)
        shard = str(pdf["shard"].iloc[0])
        pdf["container"] = [f"s-{shard}-{k}" for k in at]
        return pdf[["window_name", "doc_id", "piece", "tokens", "container"]]

    return full.unionByName(rest.groupBy("window_name", "capacity", "shard").applyInPandas(pack, schema))
