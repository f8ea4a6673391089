"""Tables that grow: upserts, resumed work, look-ups by precedence, edges of new nodes, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.dedupe import keep_first


def upserted(existing: DataFrame, arrived: DataFrame, key: str, order: list[Column | str], columns: list[str]) -> DataFrame:
    """The existing rows as they are, and of the arrived ones the first of each key that is not there yet. Rows without a
    key come once."""
    new = keep_first(arrived, [key], order, columns)
    return existing.select(*columns).unionByName(new.join(existing.select(key).distinct(), key, "left_anti").select(*columns))


def last_of(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key in the order given."""
    row, place = F.struct(*[F.col(c) for c in columns]), F.struct(*[F.col(o) for o in order])
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max_by(row, place).alias("__row")).select("__row.*")


def resumed(inputs: DataFrame, results: DataFrame, key: str, done: str, columns: list[str]) -> DataFrame:
    """Inputs, with the columns of an earlier result where that is done."""
    named = results.where(F.coalesce(F.col(done), F.lit(False))).select(F.col(key), F.struct(*columns).alias("__earlier"))
    picked = [F.when(F.col("__earlier").isNotNull(), F.col(f"__earlier.{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return inputs.select(key, *columns).join(named, key, "left").select(key, *picked)


def backfilled(first: DataFrame, second: DataFrame, key: str, taken: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of ``first``, and those of ``second`` whose key it lacks, less the keys ``taken``, only with keys ``present``."""
    rows = first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))
    return rows.join(taken.select(key).distinct(), key, "left_anti").join(present.select(key).distinct(), key, "left_semi")


def cited_edges(references: DataFrame, ids: DataFrame, key: str = "doi", cited: str = "cited", node: str = "id") -> DataFrame:
    """``source, target`` of reference lists (a key and an array of keys), both ends resolved, without loops, each once.
    ``ids`` has one node for each key."""
    end = lambda k, n: ids.select(F.col(key).alias(k), F.col(node).alias(n))
    rows = references.select(F.col(key).alias("__from"), F.explode(cited).alias("__to"))
    return rows.join(end("__from", "source"), "__from").join(end("__to", "target"), "__to").where("source <> target").select("source", "target").distinct()


def across(edges: DataFrame, fields: DataFrame, source: str = "source", target: str = "target", node: str = "id", field: str = "field") -> DataFrame:
    """Edges whose ends belong to different fields, with these fields."""
    end = lambda k, n: fields.select(F.col(node).alias(k), F.col(field).alias(n))
    return edges.join(end(source, "source_field"), source).join(end(target, "target_field"), target).where("source_field <> target_field")


def with_new_nodes(edges: DataFrame, found: DataFrame, new: DataFrame, node: str = "id", source: str = "source", target: str = "target") -> DataFrame:
    """Edges found that touch a new node and are not there yet."""
    fresh = new.select(F.col(node).alias("__new")).distinct()
    touching = found.join(fresh, found[source] == fresh["__new"], "left_semi").unionByName(found.join(fresh, found[target] == fresh["__new"], "left_semi"))
    return touching.distinct().join(edges.select(source, target).distinct(), [source, target], "left_anti")


def first_existing(candidates: DataFrame, key: str, names: str, listing: DataFrame, name: str) -> DataFrame:
    """``key, name``: of each key's names, in their order, the first that the listing has."""
    rows = candidates.select(F.col(key), F.posexplode(names).alias("__pos", name))
    return rows.join(listing.select(name).distinct(), name, "left_semi").groupBy(key).agg(F.min_by(name, "__pos").alias(name))


def work_list(documents: DataFrame, key: str, settings: DataFrame, done: DataFrame, most: int = 10_000) -> DataFrame:
    """Each document with each setting (a row of a small table), less what is done. The settings are counted first, as they
    travel with every document."""
    names = settings.columns
    rows = settings.distinct().limit(most + 1)
    if rows.count() > most:
        raise ValueError(f"more than {most} settings: pass them in parts")
    listed = rows.agg(F.collect_list(F.struct(*names)).alias("__settings"))
    every = documents.select(key).distinct().join(F.broadcast(listed)).select(key, F.inline("__settings"))  # one row on the right
    return every.join(done.select(key, *names).distinct(), [key, *names], "left_anti")


def matched_titles(left: DataFrame, right: DataFrame, key: Column, other: Column, order: list[str], node: str) -> DataFrame:
    """Rows of ``left`` with ``node`` of the last row of ``right`` of the same normalised title; null where there is none."""
    last = right.select(other.alias("__title"), F.struct(*order).alias("__order"), node).where("__title <> ''").groupBy("__title").agg(F.max_by(node, "__order").alias(node))
    return left.withColumn("__title", key).join(last, "__title", "left").drop("__title")


def attempt_with_result(attempts: DataFrame, key: list[str], order: list[str], ok: Column, columns: list[str]) -> DataFrame:
    """Of recorded attempts the first one with a result, with its number from 1; keys without any result are left out."""
    listed = attempts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, ok.alias("__ok"), *columns))).alias("__all"))
    at = F.array_position(F.transform("__all", lambda x: F.coalesce(x["__ok"], F.lit(False))), True).cast("int")
    listed = listed.withColumn("attempt", at).where("attempt > 0")
    return listed.select(*key, "attempt", *[F.get("__all", F.col("attempt") - 1)[c].alias(c) for c in columns])


def cluster_counts(membership: DataFrame, cited: DataFrame, marked: DataFrame, cluster: str, node: str = "node", least: int = 10) -> DataFrame:
    """``size, highly_cited, marked`` of each cluster. ``cited``: node, n; ``marked``: nodes."""
    marks = marked.select(node).distinct().withColumn("__marked", F.lit(True))
    return (
        membership.join(cited, node, "left").join(marks, node, "left").groupBy(cluster)
        .agg(F.count("*").alias("size"), F.count_if(F.col("n") >= least).alias("highly_cited"), F.count_if("__marked").alias("marked"))
    )


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of either side, of both together, and common ones."""
    sides = a.select(F.col(key).alias("k"), F.lit(1).alias("s")).unionByName(b.select(F.col(key).alias("k"), F.lit(2).alias("s"))).where("k is not null")
    each = sides.groupBy("k").agg(F.bit_or("s").alias("s"))
    return each.agg(
        F.count_if(F.col("s") != 2).alias("left_n"), F.count_if(F.col("s") != 1).alias("right_n"), F.count("*").alias("either"), F.count_if(F.col("s") == 3).alias("common")
    )


def in_order_of(means: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Rows of the wanted keys in their order, with ``position``; keys without a row are there with nulls."""
    listed = means.sparkSession.createDataFrame([(n, k) for n, k in enumerate(wanted)], f"position int, {key} string")
    return F.broadcast(listed).join(means, key, "left")
