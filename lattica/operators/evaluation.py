"""Aggregates over runs and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_bucket(seconds: Column) -> Column:
    """Below 1, 5, 10 minutes, an hour, or longer."""
    return F.when(seconds < 60, "<1m").when(seconds < 300, "1-5m").when(seconds < 600, "5-10m").when(seconds < 3600, "10-60m").otherwise(">1h")


def variant_means(runs: DataFrame, variant: str, metrics: list[str]) -> DataFrame:
    """Means by variant; values that are no numbers don't count."""
    return runs.groupBy(variant).agg(*[F.avg(F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))).alias(f"avg_{m}") for m in metrics])


def baseline_delta(runs: DataFrame, group: str, variant: str, metric: str, baseline: str) -> DataFrame:
    """Per group and variant: its mean less the baseline's."""
    means = runs.groupBy(group, variant).agg(F.avg(metric).alias("mean"))
    base = means.where(F.col(variant) == baseline).select(group, F.col("mean").alias("base"))
    return means.where(F.col(variant) != baseline).join(base, group).select(group, variant, (F.col("mean") - F.col("base")).alias("delta"))


def rollup_by(events: DataFrame, server: str, ok: Column, seconds: Column, limit: float) -> DataFrame:
    """Requests, successes, failures, times and timeouts of each server."""
    return events.groupBy(server).agg(
        F.count("*").alias("requests"),
        F.count_if(ok).alias("success"),
        F.count_if(~ok).alias("failed"),
        F.sum(F.when(ok, seconds)).alias("total_s"),
        F.avg(F.when(ok, seconds)).alias("avg_s"),
        F.count_if(seconds > limit).alias("over_limit"),
    )


def server_report(events: DataFrame, server: str = "server", kind: str = "kind") -> DataFrame:
    """Per server: its requests and what became of them, timeouts, broken responses, faults and repeated attempts."""
    n = lambda *kinds: F.count_if(F.col(kind).isin(*kinds))
    counts = events.groupBy(server).agg(
        n("extracted", "failed").alias("requests"), n("extracted").alias("success"), n("failed").alias("failed"), n("timeout").alias("timeouts"),
        n("malformed").alias("malformed"), n("fault").alias("faults"), n("retry").alias("retries"), n("retry_ok").alias("retries_ok"), F.sum("triples").alias("triples"),
    )
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)) * 100, 6)
    return counts.withColumns({"success_pct": share("success", "requests"), "retry_pct": share("retries", "requests"), "retry_ok_pct": share("retries_ok", "retries")})


def completion(done: DataFrame, expected: Column, key: list[str], seconds: str) -> DataFrame:
    """One row: combinations done, left, share done, and the time left at the mean pace."""
    each = done.groupBy(*key).agg(F.avg(seconds).alias("s"))
    return each.agg(F.count("*").alias("done"), F.avg("s").alias("mean_s")).select(
        "done", (expected - F.col("done")).alias("remaining"), (F.col("done") / expected * 100).alias("pct"), (F.col("mean_s") * (expected - F.col("done"))).alias("eta_s")
    )


def recent_run(events: DataFrame, order: list[str], total: str, done: str, last: int = 50, within: int = 20) -> DataFrame:
    """The events of the current run: of the latest ones, those with the latest total and close to the highest count."""
    latest = events.orderBy(*[F.desc(o) for o in order]).limit(last)
    marks = latest.agg(F.max_by(total, F.struct(*order)).alias("__total"), F.lit(1).alias("__one"))
    same = latest.join(F.broadcast(marks), F.col(total) == F.col("__total")).drop("__one", "__total")
    top = same.agg(F.max(done).alias("__top"))
    return same.join(F.broadcast(top)).where(F.col(done) >= F.col("__top") - within).drop("__top")


def agreement(runs: DataFrame, query: str, variant: str, vector: str, cosine) -> DataFrame:
    """Mean similarity of each pair of variants over the queries they share."""
    a = runs.select(F.col(query).alias("q"), F.col(variant).alias("first"), F.col(vector).alias("x"))
    b = runs.select(F.col(query).alias("q"), F.col(variant).alias("second"), F.col(vector).alias("y"))
    return a.join(b, "q").where("first < second").groupBy("first", "second").agg(F.avg(cosine(F.col("x"), F.col("y"))).alias("similarity"))
