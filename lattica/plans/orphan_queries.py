"""Queries of problem 4: references without a live record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.orphans import OrphanTracker, references, spans
from lattica.sources.tables import table

#: Times at which the stream of references and records is cut into batches; the first and last batch are open-ended.
CUTS = ("2023-07-01", "2024-10-01")


def _batches(spark: SparkSession, folder: str):
    edges = references(
        table(spark, folder, "citation_network_edges"), "node", "citation_network_edges", "edge_id", "recorded_at", ["source", "target"]
    )
    facts = references(
        table(spark, folder, "predication"), "entity", "predication", "predication_id", "extracted_at",
        ["subject_entity_id", "object_entity_id"],
    )
    nodes = spans(table(spark, folder, "citation_network_nodes"), "node", "id", "added_at", "removed_at")
    entities = spans(table(spark, folder, "entity"), "entity", "entity_id", "created_at", "deleted_at")
    vocabulary = spans(table(spark, folder, "vocab_entity"), "entity", "entity_id")
    refs, parents = edges.unionByName(facts), nodes.unionByName(entities).unionByName(vocabulary)
    bounds = [None, *[F.lit(c).cast("timestamp_ntz") for c in CUTS], None]
    for low, high in zip(bounds, bounds[1:]):
        part = lambda df, col, low=low, high=high: reduce(
            lambda d, c: d.where(c),
            [c for c in (
                None if low is None else F.col(col) >= low,
                None if high is None else (F.col(col) < high) | (F.col(col).isNull() if low is None else F.lit(False)),
            ) if c is not None],
            df,
        )
        yield part(refs, "at"), part(parents, "live_from"), high


def tracker(spark: SparkSession, folder: str) -> OrphanTracker:
    state = OrphanTracker(spark)
    for refs, parents, _ in _batches(spark, folder):
        state.ingest(refs, parents)
    return state


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return tracker(spark, folder).found()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, field and month."""
    return tracker(spark, folder).report()


def p4_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Open references at the end of each batch but the last, as the state stands then."""
    state, out = OrphanTracker(spark), []
    for refs, parents, high in _batches(spark, folder):
        state.ingest(refs, parents)
        if high is not None:
            out.append(state.snapshot(high))
    return reduce(DataFrame.unionByName, out)


_REFS = """
    select 'citation_network_edges' table_name, 'source' ref_field, edge_id::varchar row_key, 'node' as space, source::varchar k, recorded_at t from citation_network_edges
    union all select 'citation_network_edges', 'target', edge_id::varchar, 'node', target::varchar, recorded_at from citation_network_edges
    union all select 'predication', 'subject_entity_id', predication_id, 'entity', lower(trim(subject_entity_id)), extracted_at from predication
    union all select 'predication', 'object_entity_id', predication_id, 'entity', lower(trim(object_entity_id)), extracted_at from predication"""
_PARENTS = """
    select 'node' as space, id::varchar k, added_at a, removed_at z from citation_network_nodes
    union all select 'entity', lower(trim(entity_id)), created_at, deleted_at from entity
    union all select 'entity', lower(trim(entity_id)), null, null from vocab_entity"""
_FOUND = f"""
    with r as (select * from ({_REFS}) where k is not null and k <> ''), p as ({_PARENTS}),
    ok as (select distinct r.table_name, r.ref_field, r.row_key, r.k, r.t from r join p on r.space = p.space and r.k = p.k
        and (r.t is null or ((p.a is null or p.a <= r.t) and (p.z is null or r.t < p.z))))
    select distinct table_name, ref_field, row_key, coalesce(strftime(t, '%Y-%m'), 'unknown') period
    from r where not exists (select 1 from ok where ok.table_name = r.table_name and ok.ref_field = r.ref_field
        and ok.row_key is not distinct from r.row_key and ok.k = r.k and ok.t is not distinct from r.t)"""


def _snapshot_sql() -> str:
    one = """
    select '{d}' as_of, table_name, ref_field, period, count(*) refs, count(*) filter (where not live) open_refs from (
        select r.table_name, r.ref_field, coalesce(strftime(r.t, '%Y-%m'), 'unknown') period,
            exists (select 1 from p where p.space = r.space and p.k = r.k and (p.a is null or p.a <= timestamp '{d}') and (p.z is null or timestamp '{d}' < p.z)) live
        from r where r.t is null or r.t < timestamp '{d}') group by all"""
    return f"with r as (select * from ({_REFS}) where k is not null and k <> ''), p as ({_PARENTS})" + " union all ".join(
        one.format(d=d) for d in CUTS
    )


QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p4_snapshots": p4_snapshots}
ORACLE = {
    "p4_found": _FOUND,
    "p4_report": f"select table_name, ref_field, period, count(*) orphans from ({_FOUND}) group by all",
    "p4_snapshots": _snapshot_sql(),
}
