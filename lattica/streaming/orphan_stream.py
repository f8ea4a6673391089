"""The orphan tracker over streams: each micro-batch is one batch of the tracker's state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.operators.orphans import OrphanTracker


def track(
    spark: SparkSession, events: DataFrame, checkpoint: str, report: Callable[[DataFrame, int], None] | None = None
) -> tuple[StreamingQuery, OrphanTracker]:
    """Runs the tracker over ``events``: rows with ``kind`` ('reference', 'span' or 'removal') and the columns of all.

    ``report`` gets the current orphans after each micro-batch. The state lives beside the query's checkpoint and keeps
    the number of its last batch: a restarted query goes on from there, and a batch that is brought again is taken once.
    """
    state = OrphanTracker(spark, f"{checkpoint}/orphans")

    def batch(df: DataFrame, batch_id: int) -> None:
        refs = df.where("kind = 'reference'").select("space", "key", "table_name", "ref_field", "row_key", "at")
        spans = df.where("kind = 'span'").select("space", "key", "live_from", "live_until")
        removed = df.where("kind = 'removal'").select("space", "key", "live_until")
        state.ingest(refs, spans, None if removed.isEmpty() else removed, batch_id)
        if report:
            report(state.found(), batch_id)
        state.prune()

    query = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query, state


def late_counts(events: DataFrame, at: str, delay: str, window: str, key: str) -> DataFrame:
    """Counts per time window and key over a stream; rows later than ``delay`` behind the newest are dropped by the watermark."""
    return (
        events.withWatermark(at, delay)
        .groupBy(F.window(F.col(at), window).alias("window"), F.col(key).alias("key"))
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "key", "n")
    )
