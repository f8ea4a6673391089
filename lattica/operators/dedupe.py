"""Deduplication whose survivor is defined by an order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import written


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column | str], columns: list[str] | None = None) -> DataFrame:
    """The first row of each key; null keys are a key of their own. One aggregate with map-side combine, so a hot key is
    one row per task: the row travels as the struct that the order is the least of. ``columns``: those that the result
    keeps; name them, as the scan can't be pruned through the struct."""
    # the row is packed first, so that no column's name can clash
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in columns or df.columns]).alias("__row"),
        F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)]).alias("__order"),
        *[(F.col(k) if isinstance(k, str) else k).alias(f"__key{i}") for i, k in enumerate(keys)],
    )
    return packed.groupBy(*[f"__key{i}" for i in range(len(keys))]).agg(F.min_by("__row", "__order").alias("__row")).select("__row.*")


def duplicates(df: DataFrame, fields: list[str], key) -> DataFrame:
    """Each raw spelling of the fields whose normalised form comes more than once, with that form's frequency."""
    keyed = df.groupBy(*fields).agg(F.count("*").alias("n")).select("*", *[key(F.col(f)).alias(f"key_{f}") for f in fields])
    counts = keyed.groupBy(*[f"key_{f}" for f in fields]).agg(F.sum("n").alias("frequency")).where("frequency > 1")
    return keyed.join(counts, [f"key_{f}" for f in fields]).select(*fields, "frequency")


def processed_first(df: DataFrame, key: str, processed: str, order: list[Column | str], columns: list[str] | None = None) -> DataFrame:
    """Of rows with the same key the first processed one, else the last; rows without a key all stay. ``columns``: those
    that the result keeps."""
    df = df.select(*dict.fromkeys([*columns, key, processed, *order])) if columns else df
    is_done = F.coalesce(F.col(processed), F.lit(False))
    done = df.where(F.col(key).isNotNull() & is_done)
    rest = df.where(F.col(key).isNotNull() & ~is_done)
    first = keep_first(done, [key], order)
    columns = [F.col(f"`{c}`") for c in df.columns]
    last = (
        rest.join(done.select(key).distinct(), key, "left_anti")
        .groupBy(key)
        .agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__row"))
        .select("__row.*")
    )
    return first.unionByName(last.select(*first.columns)).unionByName(df.where(F.col(key).isNull()))


def ordinals(df: DataFrame, key: str, order: Column | str, name: str = "ordinal") -> DataFrame:
    """Each distinct key with the rank, from 0, at which it first comes. Ranks are dense over the whole table: rows are
    range-partitioned, counted by partition, and only the counts (one a partition) are gathered."""
    firsts = df.groupBy(key).agg(F.min(order).alias("__first"))
    return dense_ids(firsts, ["__first", key], name).drop("__first")


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0..n-1 in the order given, without bringing all rows into one task."""
    parts = df.repartitionByRange(*[F.col(o) for o in order]).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    parts = written(parts.withColumn("__pos", F.monotonically_increasing_id()), "ranges")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__pos").alias("__base"))
    # one row for each partition of the range exchange: a bounded table
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (
        parts.join(F.broadcast(offsets.select("__part", "__base", "__offset")), "__part")
        .withColumn(name, (F.col("__pos") - F.col("__base") + F.col("__offset")).cast("long"))
        .drop("__part", "__pos", "__base", "__offset")
    )
